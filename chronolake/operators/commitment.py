"""The Merkle-Patricia root of a table of keys and values, subtree by subtree."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronolake.functions import rlp
from chronolake.functions.keccak import keccak256
from chronolake.operators.ordered import global_rank, neighbour
from chronolake.session import materialize
from chronolake.sources.store import VersionedTable

#: Hashes of the empty tree and of empty code.
EMPTY_ROOT = bytes.fromhex("56e81f171bcc55a6ff8345e692c0f86e5b48e01b996cadc001622fb5e363b421")
EMPTY_CODE = bytes.fromhex("c5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470")
GROUP = 2


def _compact(path: Sequence[int], leaf: bool) -> bytes:
    """A path of nibbles as bytes, its parity and kind in the first nibble."""
    flag = 2 * leaf + len(path) % 2
    nibbles = [flag, *path] if len(path) % 2 else [flag, 0, *path]
    return bytes(16 * a + b for a, b in zip(nibbles[::2], nibbles[1::2]))


class Branch:
    """A branch with open nodes as children by nibble; its bytes are known once those of its children are."""

    def __init__(self, children: dict[int, tuple]) -> None:
        self.children = children
        self.height = 1 + max((c[2].height for c in children.values() if isinstance(c[2], Branch)), default=0)
        self.encoded = b""


def _references(encoded: list[bytes]) -> list[bytes]:
    """How a parent refers to nodes: short ones lie in it, of others it has the hash. Hashed all at once."""
    long = [i for i, e in enumerate(encoded) if len(e) >= 32]
    out = list(encoded)
    for i, h in zip(long, keccak256([encoded[i] for i in long])):
        out[i] = rlp.encode(h)
    return out


def _finished(nodes: list[tuple]) -> list[bytes]:
    """The bytes of open nodes (path, is it a leaf, value or bytes of the branch behind the path)."""
    behind = [i for i, (path, leaf, _) in enumerate(nodes) if path and not leaf]
    refs = dict(zip(behind, _references([nodes[i][2] for i in behind])))
    out = []
    for i, (path, leaf, payload) in enumerate(nodes):
        if leaf:
            out.append(rlp.encode([_compact(path, True), payload]))
        elif path:
            body = rlp.encode(_compact(path, False)) + refs[i]
            out.append(rlp._prefix(0xC0, len(body)) + body)
        else:
            out.append(payload)
    return out


def _seal(branches: list[Branch]) -> None:
    """Fills in the bytes of branches, all of one height at a time."""
    for height in sorted({b.height for b in branches}):
        level = [b for b in branches if b.height == height]
        slots = [(b, i) for b in level for i in b.children]
        nodes = [(p, leaf, x.encoded if isinstance(x, Branch) else x) for p, leaf, x in (b.children[i] for b, i in slots)]
        refs = dict(zip(((id(b), i) for b, i in slots), _references(_finished(nodes))))
        for b in level:
            body = b"".join(refs.get((id(b), i), b"\x80") for i in range(16)) + b"\x80"
            b.encoded = rlp._prefix(0xC0, len(body)) + body


def _join(nodes: list[tuple[tuple[int, ...], tuple]], depth: int, made: list[Branch]) -> tuple:
    """The open node above nodes with full paths: (rest of the path below ``depth``, is it a leaf, value or branch). Nodes are
    sorted; an open node can still grow towards the root, so a lone child becomes part of a longer path."""
    if len(nodes) == 1:
        path, (rest, leaf, payload) = nodes[0]
        return (path[depth:] + tuple(rest), leaf, payload)
    first, last = nodes[0][0], nodes[-1][0]
    fork = depth
    while first[fork] == last[fork]:
        fork += 1
    children, begin = {}, 0
    for i in range(1, len(nodes) + 1):
        if i == len(nodes) or nodes[i][0][fork] != nodes[begin][0][fork]:
            children[nodes[begin][0][fork]] = _join(nodes[begin:i], fork + 1, made)
            begin = i
    made.append(Branch(children))
    return (first[depth:fork], False, made[-1])


def _nibbles(hexed: str) -> tuple[int, ...]:
    return tuple(int(c, 16) for c in hexed)


def _level(depth: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("path")
        nodes = [(_nibbles(p), (_nibbles(r), bool(leaf), bytes(x))) for p, r, leaf, x in zip(rows["path"], rows["rest"], rows["leaf"], rows["payload"])]
        made: list[Branch] = []
        rest, leaf, payload = _join(nodes, depth, made)
        _seal(made)
        payload = payload.encoded if isinstance(payload, Branch) else payload
        return pd.DataFrame({"path": [rows["path"].iloc[0][:depth]], "rest": ["".join(f"{n:x}" for n in rest)], "leaf": [leaf], "payload": [payload]})

    return build


@F.pandas_udf(T.StringType())
def hashed_path(keys: pd.Series) -> pd.Series:
    """The nibbles of each key's hash, as hex text."""
    return pd.Series([h.hex() for h in keccak256([bytes(k) for k in keys])], dtype=object)


def leaves_of(entries: DataFrame, radix: int = 16) -> DataFrame:
    """Binary keys ``k`` and values ``v`` as leaves of the tree: (``path``, ``rest``, ``leaf``, ``payload``). The path is the hash of
    the key, in digits of 4 bits, or with radix 2 in bits. NULL keys or values are left out."""
    path = hashed_path("k")
    if radix == 2:
        path = F.array_join(F.transform(F.split(path, ""), lambda c: F.lpad(F.conv(c, 16, 2), 4, "0")), "")
    return entries.where("k is not null and v is not null").select(path.alias("path"), F.lit("").alias("rest"), F.lit(True).alias("leaf"), F.col("v").alias("payload"))


def fold(nodes: DataFrame, depth: int) -> DataFrame:
    """Nodes joined to one open node for each prefix of ``depth`` digits, of the same columns."""
    return nodes.groupBy(F.substring("path", 1, depth).alias("prefix")).applyInPandas(_level(depth), "path string, rest string, leaf boolean, payload binary")


def root_of(nodes: DataFrame, depth: int, radix: int = 16) -> DataFrame:
    """(``root``): the root hash above open nodes of ``depth`` digits, as hex; GROUP nibbles are joined at once."""
    group = GROUP * (4 if radix == 2 else 1)
    while depth:
        depth = max(0, depth - group)
        nodes = fold(nodes, depth)

    @F.pandas_udf(T.StringType())
    def finish(rest: pd.Series, leaf: pd.Series, payload: pd.Series) -> pd.Series:
        done = _finished([(_nibbles(r), bool(is_leaf), bytes(p)) for r, is_leaf, p in zip(rest, leaf, payload)])
        return pd.Series([h.hex() for h in keccak256(done)], dtype=object)

    root = nodes.select(finish("rest", "leaf", "payload").alias("root"))
    return root.agg(F.coalesce(F.max("root"), F.lit(EMPTY_ROOT.hex())).alias("root"))


def state_root(entries: DataFrame, depth: int | None = None, radix: int = 16) -> DataFrame:
    """(``root``): the root hash, as hex, of a table of different binary keys ``k`` and binary values ``v``.

    Paths are hashes of keys, so subtrees below equal prefixes are of equal size. Subtrees are built where their rows are;
    each is one open node, and nodes of GROUP nibbles are joined level by level up to the root. ``depth``: the length of
    the first prefix, by default for about 32768 keys a subtree at most. With radix 2 branches have two children and paths are
    bits, written a digit a bit. NULL keys or values are left out; an empty table has the root of the empty tree; repeated
    keys are an error.
    """
    if depth is None:
        n, depth = entries.count(), 0
        while n > 32_768 * radix**depth:
            depth += 1
    return root_of(fold(leaves_of(entries, radix), depth), depth, radix)


class TreeState:
    """A tree that is kept between runs: its open nodes at ``depth`` digits. After a change only the subtrees of touched keys are
    built again, from the values those subtrees have now; the others come from what was kept.

    With ``depth`` digits there are at most 16**depth nodes, each at most as large as a branch.
    """

    def __init__(self, spark: SparkSession, path: str, depth: int = 2) -> None:
        self.table, self.depth = VersionedTable(spark, path), depth

    def save(self, entries: DataFrame) -> int:
        """Keeps the state of a whole table of keys and values."""
        return self.table.commit(fold(leaves_of(entries), self.depth))

    def update(self, entries: DataFrame, touched: DataFrame) -> int:
        """Keeps the state after the keys ``k`` of ``touched`` got the values that ``entries`` has, or went."""
        prefix = F.substring(hashed_path("k"), 1, self.depth)
        stale = materialize(touched.where("k is not null").select(prefix.alias("stale")).distinct(), "stale")
        now = entries.withColumn("__p", prefix).join(stale, F.col("__p") == F.col("stale"), "left_semi").select("k", "v")
        kept = self.table.view().join(stale, F.substring("path", 1, self.depth) == F.col("stale"), "left_anti")
        return self.table.commit(kept.unionByName(fold(leaves_of(now), self.depth)))

    def root(self) -> DataFrame:
        return root_of(self.table.view(), self.depth)


def review_keys(touched: DataFrame, state: DataFrame) -> DataFrame:
    """(``k``, ``v``): touched keys with the value they have now, NULL for those that are gone."""
    return touched.select("k").where("k is not null").distinct().join(state.select("k", "v"), "k", "left")


def binary_branches(keys: DataFrame, key: str, bits: int) -> DataFrame:
    """(``depth``, ``prefix``): the branches of the binary tree over different whole numbers of ``bits`` bits: the bits that
    neighbours in order have in common. A tree of n keys has n - 1 branches."""
    once = keys.select(F.col(key).cast("bigint").alias("k")).where("k is not null").distinct()
    pair = neighbour(once, keys=[], time="k", take={"before": "k"}).where("before is not null")
    depth = bits - F.length(F.conv(F.col("k").bitwiseXOR(F.col("before")).cast("string"), 10, 2))
    return pair.withColumn("depth", depth).select("depth", F.expr(f"shiftright(k, {bits} - depth)").alias("prefix")).distinct()


def tree23(keys: DataFrame, key: str) -> DataFrame:
    """(``k``, ``level``, ``node``): different keys as a 2-3 tree: ``level`` 1 are the leaves, ``node`` is the rank of the first key
    below a node. Nodes hold one or two keys, have one child more, and all leaves are on one level.

    Nodes are split from the root down, a level at a time; what a node splits into follows from how many keys are below it,
    so only ranks are needed and keys come last.
    """
    ranked = global_rank(keys.select(F.col(key).alias("k")).where("k is not null").distinct(), order="k", name="rank")
    n = ranked.count()
    height = 0
    while 3**height - 1 < n:
        height += 1
    spark = keys.sparkSession
    nodes, held = spark.createDataFrame([(0, n)] if n else [], "first bigint, size bigint"), None
    for level in range(height, 0, -1):
        most = 3 ** (level - 1) - 1  # keys that a child can take
        two = F.col("size") - 1 <= 2 * most if level > 1 else F.col("size") == 1
        left = F.col("size") - F.when(two, 1).otherwise(2)
        parts = F.when(two, F.lit(2)).otherwise(3)
        size = lambda i: F.floor((left + parts - 1 - i) / parts).cast("bigint")
        split = nodes.withColumn("parts", parts).withColumn("a", size(0)).withColumn("b", size(1)).withColumn("c", F.when(two, F.lit(0).cast("bigint")).otherwise(size(2)))
        first, second = F.col("first") + F.col("a"), F.col("first") + F.col("a") + F.col("b") + 1
        own = F.when(F.col("parts") == 2, F.array(first)).otherwise(F.array(first, second))
        part = split.select(F.explode(own).alias("rank"), F.lit(level).alias("level"), F.col("first").alias("node"))
        held = part if held is None else held.union(part)
        child = F.array(F.struct(F.col("first").alias("first"), F.col("a").alias("size")), F.struct((first + 1).alias("first"), F.col("b").alias("size")))
        child = F.when(F.col("parts") == 2, child).otherwise(F.concat(child, F.array(F.struct((second + 1).alias("first"), F.col("c").alias("size")))))
        nodes = split.select(F.explode(child).alias("x")).select("x.first", "x.size") if level > 1 else nodes
        if (height - level) % 6 == 5:  # some hundred times as many nodes: spread them, and cut the lineage
            nodes = materialize(nodes.repartition("first"), "nodes")
    if held is None:
        return ranked.select("k", F.lit(0).alias("level"), F.lit(0).cast("bigint").alias("node")).limit(0)
    return ranked.join(held, "rank").select("k", "level", "node")


@F.pandas_udf(T.BinaryType())
def account_value(nonce: pd.Series, balance: pd.Series) -> pd.Series:
    """The value of an account without storage and code: nonce and balance (text of a whole number)."""
    return pd.Series([rlp.encode([rlp.number(int(n)), rlp.number(int(b)), EMPTY_ROOT, EMPTY_CODE]) for n, b in zip(nonce, balance)], dtype=object)


def touched_keys(log: DataFrame, since: int) -> DataFrame:
    """(``k``, ``path``): different keys changed from ``since`` on with the path of their hash, as the tree takes them."""
    return log.where((F.col("tx") >= since) & F.col("k").isNotNull()).select("k").distinct().withColumn("path", hashed_path(F.col("k").cast("string").cast("binary")))


def merge_branches(updates: DataFrame) -> DataFrame:
    """(``prefix``, ``touched``, ``present``): branch updates (``seq``, ``prefix``, ``nibble``, ``cell``) as bit masks: which
    children were ever touched, and which of them the last update left there (``cell`` not NULL)."""
    last = updates.groupBy("prefix", "nibble").agg(F.max(F.struct("seq", "cell")).alias("x")).select("prefix", "nibble", F.col("x.cell").alias("cell"))
    bit = F.expr("shiftleft(1, nibble)")
    return last.groupBy("prefix").agg(F.bit_or(bit).alias("touched"), F.bit_or(F.when(F.col("cell").isNotNull(), bit).otherwise(0)).alias("present"))
