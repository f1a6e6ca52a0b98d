"""Mails, contamination, mixing and splitting against plain models."""

from __future__ import annotations

import base64
import quopri
import random
import sys
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from conftest import rows  # noqa: E402

from chronolake.llm.contamination import leaked_items  # noqa: E402
from chronolake.llm.mime import text_parts, words  # noqa: E402
from chronolake.llm.mix import leaf_budgets as budgets_of  # noqa: E402
from chronolake.llm.mix import mix, planned_shares, reached_shares  # noqa: E402
from chronolake.llm.split import split_oversized, split_text  # noqa: E402
from chronolake.llm.queries import TOKENIZER  # noqa: E402
from chronolake.llm.tokens import count_tokens, encoder  # noqa: E402

needs_tokens = pytest.mark.skipif(not Path(TOKENIZER).exists(), reason="no tokenizer file")


def part(kind, body, coding="7bit", charset="utf-8", sep="; "):
    return f"Content-Type: {kind}{sep}charset={charset}\nContent-Transfer-Encoding: {coding}\n\n{body}"


def multi(*parts, mark="b1", end=True, kind="mixed"):
    return f'Subject: x\nContent-Type: multipart/{kind};\n boundary="{mark}"\n\npreamble\n' + "".join(f"--{mark}\n{p}\n" for p in parts) + (f"--{mark}--\nepilogue" if end else "")


def test_parts():
    b64 = base64.encodebytes("zwölf Wörter".encode("latin-1")).decode()
    qp = quopri.encodestring("naïve café = lang".encode()).decode()
    assert text_parts("A: b\n\nbody") == ["body"]
    assert text_parts("A: b\n" + part("text/plain", b64, "BASE64", "ISO-8859-1", ";\n\t")) == ["zwölf Wörter"]
    assert text_parts("A: b\n" + part("TEXT/Plain", qp, "Quoted-Printable")) == ["naïve café = lang"]
    assert text_parts("A: b\r\n" + part("text/plain", "x\ny", charset="latin-1").replace("\n", "\r\n")) == ["x\r\ny"]
    html = "<html><head><style>p{}</style></head><!-- no --><p>One<br>t<b>w</b>o &amp; thr&#101;e</p></html>"
    assert words(text_parts("A: b\n" + part("text/html", html))[0]) == ["one", "two", "three"]
    deep = part("text/plain", "at the bottom")
    for level in range(120):
        deep = multi(deep, mark=f"m{level}", end=level % 2 == 0)
    assert [words(x) for x in text_parts(deep)] == [["at", "the", "bottom"]]
    inner = multi(part("text/plain", "deep"), part("text/html", "<i>deep</i>"), mark="in", kind="alternative", end=False)
    mail = multi(inner, part("image/png", "aaaa", "base64"), part("text/plain", "file", charset="utf-8; name=a.txt"), mark="out")
    assert [words(x) for x in text_parts(mail)] == [["deep"], ["deep"], ["file"]]
    assert [x.strip() for x in text_parts(multi("\nplain by default", end=False))] == ["plain by default"]
    assert text_parts(None) == [] and text_parts("") == [] and text_parts("no header at all") == ["no header at all"]
    assert text_parts("From me Thu\nA: b\nBroken-Line\nContent-Transfer-Encoding\n\nx") == ["x"]
    assert text_parts("A: b\nContent-Type: multipart/mixed\n\n--q\n\nfound\n--q--\n")[0].strip() == "found"
    assert words(text_parts("A: b\n" + part("text/plain", "YWJjIGRlZiBnaGk", "base64", "nonsense"))[0]) == ["abc", "def", "ghi"]
    assert words(text_parts("A: b\nContent-Type: message/rfc822\n\nC: d\n\ninside")[0]) == ["inside"]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab-=:;\r\n \t\"<>&/Content-Type: multipart/mixed boundary=x--", max_size=300))
def test_parts_never_fail(text):
    text_parts(text)
    text_parts("Content-Type: multipart/mixed; boundary=x\n\n--x\n" + text)
    text_parts("A: b\n" + part("text/html", text, "quoted-printable"))


@pytest.mark.parametrize("max_broadcast", [10**8, 0])
def test_contamination_against_brute_force(spark, max_broadcast):
    r = random.Random(6)
    vocabulary = [f"w{i}" for i in range(12)]
    text = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(i, text(r.randint(10, 30))) for i in range(12)] + [(90, []), (91, text(12))]
    items += [(92, items[0][1]), (93, ["the"] * 20)]
    docs = []
    for d in range(60):
        w = text(40)
        for _ in range(r.randint(0, 2)):
            src = r.choice(items[:13])[1]
            n = r.randint(11, 14)
            at, a = r.randint(0, 40), r.randint(0, max(0, len(src) - n))
            w[at:at] = src[a : a + n]
        docs.append((d, " ".join(x.upper() if r.random() < 0.2 else x for x in w).replace(" ", ", ", 3)))
    docs += [(100, None), (101, ""), (102, "the " * 14), (102, "the " * 14), (103, "the " * 12), (104, "x " * 200_000 + " ".join(items[1][1]))]
    want = set()
    for d, t in docs:
        w = words(t or "")
        grams = {tuple(w[i : i + 13]) for i in range(len(w) - 12)}
        want |= {(d, i) for i, ws in items if any(tuple(ws[k : k + 13]) in grams for k in range(len(ws) - 12))}
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    it = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(99, None)], "item_id long, text string")
    got = leaked_items(df, it, read=lambda t: [t or ""], max_broadcast=max_broadcast)
    assert rows(got) == sorted(want) and len(want) > 20
    assert leaked_items(df.limit(0), it).count() == 0 and leaked_items(df, it.limit(0)).count() == 0


def test_a_full_mask_loses_nothing(spark, monkeypatch):
    from chronolake.llm import contamination

    monkeypatch.setattr(contamination, "MAX_BITS", 4)
    item = " ".join(f"p{i}" for i in range(40))
    docs = [(1, "a b " + item), (2, " ".join(f"p{i}" for i in range(12))), (3, " ".join(f"q{i}" for i in range(400))), (4, " ".join(f"p{i}" for i in range(20, 33)))]
    got = leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([("i", item)], "item_id string, text string"), read=lambda t: [t])
    assert rows(got) == [(1, "i"), (4, "i")]


def test_passage_must_lie_in_one_part(spark):
    w = [f"p{i}" for i in range(20)]
    item = spark.createDataFrame([(1, " ".join(w))], "item_id long, text string")
    mails = [
        (1, multi(part("text/plain", "> " + "\n> ".join(w[2:15])), part("text/plain", "other"))),
        (2, multi(part("text/plain", " ".join(w[:8])), part("text/plain", " ".join(w[8:])))),
        (3, multi(part("application/pdf", " ".join(w)))),
        (4, "A: b\n" + part("text/html", "<p>" + "<br>".join(w[5:19]) + "</p>")),
    ]
    assert rows(leaked_items(spark.createDataFrame(mails, "doc_id long, text string"), item)) == [(1, 1), (4, 1)]


@dataclass
class Node:
    """A node of the domain-language-source tree; a leaf has a weight and a capacity, others get theirs from children."""

    weight: float = 0.0
    capacity: float = 0.0
    children: dict[object, Node] = field(default_factory=dict)
    budget: float = 0.0

    def add(self, path: Sequence[object], weight: float, capacity: float) -> None:
        self.weight += weight
        self.capacity += capacity
        if path:
            self.children.setdefault(path[0], Node()).add(path[1:], weight, capacity)

    def share_out(self, budget: float) -> None:
        """Gives the budget to the children by weight. What a child can't take goes to its siblings; a child is never given
        more than its whole subtree can take, so a shortage leaves a subtree only when all inside is full."""
        self.budget = min(budget, self.capacity)
        open_, left, given = dict(self.children), self.budget, dict.fromkeys(self.children, 0.0)
        while open_ and left > 1e-9:
            total = sum(c.weight for c in open_.values())
            want = {k: left * (c.weight / total if total > 0 else c.capacity / max(1e-300, sum(x.capacity for x in open_.values()))) for k, c in open_.items()}
            full = [k for k, c in open_.items() if given[k] + want[k] >= c.capacity]
            for k in full or list(open_):
                take = min(want[k], open_[k].capacity - given[k])
                given[k] += take
                left -= take
            if not full:
                break
            for k in full:
                del open_[k]
        for k, c in self.children.items():
            c.share_out(given[k])


def leaf_budgets(leaves: Sequence[tuple], targets: Mapping[object, tuple[float, int]], domain_of: Mapping[object, str], total: float | None = None) -> dict[tuple, float]:
    """{(source, language): tokens} for leaves (source, language, tokens). ``targets``: source to (share, most repeats).

    A source's share is spread over its languages by their tokens. ``total`` defaults to the tokens of all leaves. A
    source without tokens is a leaf of no capacity in its domain: its share goes to the sources of that domain first.
    """
    tokens: dict[object, float] = {}
    for source, _, n in leaves:
        tokens[source] = tokens.get(source, 0) + n
    root = Node()
    for source, (share, _) in targets.items():
        if not tokens.get(source):
            root.add((domain_of.get(source, "other"), None, source), share, 0.0)
    for source, lang, n in leaves:
        if n:
            share, repeats = targets[source]
            root.add((domain_of.get(source, "other"), ("in", lang), source), share * n / tokens[source], n * repeats)
    root.share_out(sum(tokens.values()) if total is None else total)
    return {
        (source, lang[1]): leaf.budget for by_lang in root.children.values() for lang, node in by_lang.children.items() if lang is not None for source, leaf in node.children.items()
    }


def test_budgets_go_to_siblings_first():
    targets = {"a": (0.5, 1), "b": (0.3, 4), "c": (0.2, 4)}
    got = leaf_budgets([("a", "en", 10), ("b", "en", 50), ("c", "en", 50)], targets, {"a": "x", "b": "x", "c": "y"}, 100)
    assert got[("a", "en")] == 10 and got[("b", "en")] == pytest.approx(70) and got[("c", "en")] == pytest.approx(20)
    got = leaf_budgets([("a", "en", 10), ("b", "en", 10), ("c", "en", 500)], targets, {"a": "x", "b": "x", "c": "y"}, 100)
    assert (got[("b", "en")], got[("c", "en")]) == (pytest.approx(40), pytest.approx(50))  # x is full: its shortage moves up
    got = leaf_budgets([("c", "en", 5)], targets, {}, 100)
    assert got == {("c", "en"): 20}


@pytest.mark.parametrize("total", [None, 300, 5000, 10**7])
def test_mix_meets_its_budgets(spark, total):
    r = random.Random(9)
    docs = [(i, r.choice(["a", "a", "a", "b", "c", "x", None]), r.choice(["en", "de", None]), r.choice([None, 0, *range(1, 40)])) for i in range(400)] + [(900, "b", "en", 5000)]
    t = [("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.1, 2), ("empty", 0.1, 2), (None, 0.1, 1), ("x", 0.0, 5)]
    df = spark.createDataFrame(docs, "doc_id long, source string, lang string, n_tokens long")
    tf = spark.createDataFrame(t, "source string, target_share double, max_repeats int")
    tree = spark.createDataFrame([("a", "q"), ("b", "q"), ("zz", "y")], "source string, domain string")
    got = mix(df, tf, tree=tree, total_tokens=total)
    size = {}
    for _, s, lang, n in docs:
        if s in "abc" if s else False:
            size[s, lang] = size.get((s, lang), 0) + (n or 0)
    budgets = leaf_budgets([(s, k, n) for (s, k), n in size.items()], {x[0]: x[1:] for x in t[:4]}, {"a": "q", "b": "q"}, total)
    used, caps = {}, {x[0]: x[2] for x in t}
    for x in got.collect():
        assert x.uses + (x.part_tokens > 0) <= caps[x.source] and x.part_tokens < max(1, x.n_tokens)
        used[x.source, x.lang] = used.get((x.source, x.lang), 0) + x.n_tokens * x.uses + x.part_tokens
    for leaf, budget in budgets.items():
        assert abs(used.get(leaf, 0) - budget) <= 1
    assert rows(got) == rows(mix(df.repartition(7), tf, tree=tree, total_tokens=total))
    shares = {x.source: x.reached_share for x in reached_shares(got, tf.where("source is not null")).collect()}
    assert sum(shares.values()) == pytest.approx(1) and shares["empty"] == 0


def test_budgets_against_model(spark):
    r = random.Random(12)
    for case in range(6):
        targets = {f"s{i}": (r.choice([0.05, 0.2, 0.4]), r.randint(1, 4)) for i in range(7)}
        domains = {f"s{i}": r.choice("xyz") for i in range(5)}
        leaves = [(s, lang, r.choice([0, 1, 30, 500])) for s in targets for lang in ("en", "de", None) if r.random() < 0.7]
        total = r.choice([None, 50, 700, 10**6])
        want = {k: v for k, v in leaf_budgets(leaves, targets, domains, total).items()}
        lf = spark.createDataFrame([(s, lang or "", lang is None, n) for s, lang, n in leaves], "__src string, __l string, __none boolean, n long")
        tf = spark.createDataFrame([(s, *x) for s, x in targets.items()], "source string, share double, repeats long")
        got = {(x["__src"], None if x["__none"] else x["__l"]): x.budget for x in budgets_of(lf, tf, spark.createDataFrame(list(domains.items()), "source string, domain string"), total).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want), case


def test_more_targets_than_are_broadcast(spark, monkeypatch):
    from chronolake.llm import mix as module

    monkeypatch.setattr(module, "MAX_BROADCAST_ROWS", 2)
    df = spark.createDataFrame([(i, f"s{i % 5}", "en", 10) for i in range(100)], "doc_id long, source string, lang string, n_tokens long")
    tf = spark.createDataFrame([(f"s{i}", 0.2, 1) for i in range(5)], "source string, target_share double, max_repeats int")
    assert {x.source for x in mix(df, tf).select("source").distinct().collect()} == {f"s{i}" for i in range(5)}
    assert {x.source: round(x.planned_share, 6) for x in planned_shares(df, tf).collect()} == {f"s{i}": 0.2 for i in range(5)}


def test_mix_empty(spark):
    df, tf = spark.createDataFrame([], "doc_id long, source string, lang string, n_tokens long"), spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    assert mix(df, tf).count() == 0 and mix(spark.createDataFrame([(1, "a", "en", 3)], df.schema), tf.limit(0)).count() == 0


TEXTS = [
    "word " * 900,
    "A sentence here. " * 300,
    ("Line of text\n" * 9 + "\n") * 40,
    "無" * 1500 + "。" + "日本語" * 900,
    "x" * 3000,
    "🎉é" * 900,
    "\r\n\r\n" * 1200,
    "short",
]


@needs_tokens
@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize("most,overlap", [(64, 8), (256, 0), (100, 49)])
def test_split_round_trip(text, most, overlap):
    pieces, n = split_text(text, TOKENIZER, most, overlap), len(encoder(TOKENIZER).encode_ordinary(text))
    if n <= most:
        assert pieces == []
        return
    assert "".join(text[p[3] : p[4]] for p in pieces) == text
    assert pieces[0][0] == 0 and pieces[-1][1] == n
    assert all(b[0] == a[1] - overlap for a, b in zip(pieces, pieces[1:])) and all(p[1] - p[0] <= most for p in pieces)


@needs_tokens
@pytest.mark.parametrize("most,overlap", [(16, 2), (16, 7), (31, 0), (64, 30), (128, 16), (200, 20), (300, 100), (1024, 128), (4096, 128), (8192, 128)])
@pytest.mark.parametrize("text", [("word " * 209 + "end\n") * 41, "x1" * 9000, "Ein Satz. " * 4000, "🎉é無" * 3000])
def test_no_piece_over_any_limit(text, most, overlap):
    encode = encoder(TOKENIZER).encode_ordinary
    n, pieces = len(encode(text)), split_text(text, TOKENIZER, most, overlap)
    assert (len(pieces) > 1) == (n > most) and "".join(text[p[3] : p[4]] for p in pieces) in ("", text)
    assert max((len(encode(text[p[2] : p[4]])) for p in pieces), default=0) <= most


@needs_tokens
def test_a_text_that_cannot_be_cut_is_an_error():
    with pytest.raises(ValueError, match="can't be cut"):
        split_text("🧿🪬" * 40, TOKENIZER, 2, 0)


@needs_tokens
def test_cuts_are_as_good_as_over_all_positions():
    from chronolake.llm import split

    def cost(levels, cuts, n, most, overlap):
        step, starts = most - overlap, [overlap, *cuts[:-1]]
        target = (n - overlap) / max(1, -(-(n - overlap) // step))
        return sum(split.BALANCE * ((b - a - target) / step) ** 2 for a, b in zip(starts, cuts)) + sum(split.PENALTY[levels[c]] for c in cuts[:-1])

    r = random.Random(5)
    for _ in range(30):
        n, most = r.randint(300, 3000), r.choice([64, 200, 700])
        levels = np.array([5] + r.choices(range(5), [1, 5, 20, 100, 300], k=n - 1), np.int8)
        got = split.best_cuts(levels, n, most, 10)
        at = np.arange(11, n + 1)
        step = most - 10
        best = split._cheapest(at, np.concatenate([split.PENALTY[levels[at[:-1]]], [0.0]]), n, most, 10, (n - 10) / max(1, -(-(n - 10) // step)))
        assert cost(levels, got, n, most, 10) <= 1.02 * cost(levels, best, n, most, 10) + 0.2


@needs_tokens
def test_split_prefers_natural_boundaries():
    text = ("One line of words here\n" * 12 + "\n") * 20
    cuts = [p[5] for p in split_text(text, TOKENIZER, 200, 10)]
    assert cuts[-1] == "end" and set(cuts[:-1]) == {"paragraph"}
    assert {p[5] for p in split_text("Some words here, then more. " * 200, TOKENIZER, 200, 10)[:-1]} == {"sentence"}


@needs_tokens
@settings(max_examples=30, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(min_size=0, max_size=400), st.integers(1, 12))
def test_split_any_text(text, times):
    text = (text * times).encode("utf-8", "ignore").decode()
    pieces = split_text(text, TOKENIZER, 40, 6)
    assert not pieces or "".join(text[p[3] : p[4]] for p in pieces) == text


@needs_tokens
def test_split_frames(spark):
    df = spark.createDataFrame([(1, "a b c " * 3000, 5), (2, None, 5), (3, "", 5), (4, "tiny", 5), (1, "a b c " * 3000, 5)], "doc_id long, text string, piece int")
    got = split_oversized(df, path=TOKENIZER)
    assert got.where("doc_id = 1").count() == 2 * got.where("doc_id = 1").agg(F.max("n_pieces")).first()[0]
    assert {r[0] for r in got.select("doc_id").collect()} == {1} and got.where("piece is null").count() == 0
    assert split_oversized(df.limit(0), path=TOKENIZER).count() == 0
    with pytest.raises(ValueError):
        split_oversized(df, path=TOKENIZER, max_tokens=10, overlap=5)
    assert rows(df.select("doc_id", count_tokens(F.col("text"), TOKENIZER).alias("n")).where("doc_id > 1")) == [(2, 0), (3, 0), (4, len(encoder(TOKENIZER).encode_ordinary("tiny")))]
