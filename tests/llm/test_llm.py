import os
import random

import numpy as np
import pytest

from tidemark.llm.queries import QUERIES, SQL
from tidemark.llm import bpe, packing, truncation

PATH = bpe.VOCABULARIES
need = pytest.mark.skipif(not os.path.exists(f"{PATH}/byte_bpe_50k.tiktoken"), reason="no vocabulary files")
TEXTS = ["", " ", "  ", "a  b   c", "x\n  (a)\t y", "a" * 700, "<|endoftext|> hi", "don't I'll  'S", "   lead", "tail   ", "\n\n \n x", "中文判决" * 300, "\x1c \x1d a", "é" * 5 + "   x", "　全角 x", "  x ", "🙂👩‍👩‍👧 ok", "1,234.50 / 2024-01-31", "a\x00b", "word " * 3000]


@pytest.fixture(scope="module")
def known():
    import base64

    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(f"{PATH}/byte_bpe_50k.tiktoken", "rb"))}
    return tiktoken.Encoding("own", pat_str=bpe.PIECES, mergeable_ranks=ranks, special_tokens={})


@need
def test_ids_equal_the_public_encoder(spark, known):
    rng = random.Random(0)
    more = ["".join(rng.choice(" \n\tabcABC019.,'é中🙂") for _ in range(rng.randrange(120))) for _ in range(400)]
    rows = list(enumerate(TEXTS + more + TEXTS)) + [(-1, None)]
    df = spark.createDataFrame([(k, t, "x", [0]) for k, t in rows], "doc_id long, text string, n_tokens string, ids array<int>")
    got = {r.doc_id: r.ids for r in bpe.token_ids(df, "doc_id", "text").collect()}
    assert got == {k: known.encode_ordinary(t or "") for k, t in rows}
    assert {r.doc_id: r.n_tokens for r in bpe.token_counts(df, "doc_id", "text").collect()} == {k: len(v) for k, v in got.items()}
    assert bpe.token_ids(df.limit(0), "doc_id", "text").collect() == []


@need
def test_matrix_and_heap_agree(known):
    ranks = bpe.Ranks(open(f"{PATH}/byte_bpe_50k.tiktoken", "rb").read())
    rng = random.Random(2)
    raw = ["".join(rng.choice("abcdeht in") for _ in range(rng.randrange(1, 60))).encode() for _ in range(300)]
    m = np.full((len(raw), 60), -1, np.int32)
    for i, r in enumerate(raw):
        m[i, : len(r)] = ranks.byte[np.frombuffer(r, np.uint8)]
    ids, size = bpe.merge_matrix(m, ranks)
    for i, r in enumerate(raw):
        assert ids[i, : size[i]].tolist() == bpe.merge_long(r, ranks) and (ids[i, size[i] :] == -1).all()


def _check(out, sizes, cap):
    parts, load = {}, {}
    for r in out:
        assert 0 <= r.n_tokens <= cap
        parts.setdefault(r.k, []).append((r.from_token, r.n_tokens))
        load[r.container] = load.get(r.container, 0) + r.n_tokens
    assert set(parts) == set(sizes)
    for k, p in parts.items():
        p.sort()
        assert [a for a, _ in p] == list(np.cumsum([0] + [n for _, n in p])[:-1]) and sum(n for _, n in p) == sizes[k]
        assert len(p) == (1 if sizes[k] <= cap else -(-sizes[k] // cap))
    assert max(load.values()) <= cap
    return load


@pytest.mark.parametrize("kind", ["mixed", "one size", "halves"])
def test_packing_is_whole_tight_and_splits_only_giants(spark, kind):
    rng = random.Random(4)
    make = {"mixed": lambda: rng.choice([0, rng.randrange(1, 90), rng.randrange(1, 500)]), "one size": lambda: 34, "halves": lambda: rng.choice([50, 51, 100])}[kind]
    sizes = {i: make() for i in range(1500)}
    items = spark.createDataFrame(list(sizes.items()), "k long, n long")
    out = packing.pack(spark, items, "k", "n", [(1, 100), (2, 64), (3, None)]).collect()
    for cap in (100, 64):
        load = _check([r for r in out if r.token_capacity == cap], sizes, cap)
        used = sum(1 for v in load.values() if v)
        assert sorted(load)[-1] < used + (0 in sizes.values()) + 1
        if kind == "mixed":
            assert used <= 1.03 * sum(sizes.values()) / cap + 1


def test_packing_nothing(spark):
    none = spark.createDataFrame([], "k long, n long")
    assert packing.pack(spark, none, "k", "n", [(1, 10)]).count() == 0
    assert packing.pack(spark, none, "k", "n", []).count() == 0


def test_ranks_are_gapless_within_a_size(spark):
    df = spark.range(5000).selectExpr("id as k", "int(id % 3) as g")
    got = packing.ranked(df, ["g"], "k").groupBy("g").agg({"rank": "max", "k": "count"}).collect()
    assert all(r["max(rank)"] == r["count(k)"] - 1 for r in got)


def test_nnls_solves():
    a = np.array([[1.0, 0, 2], [0, 1, 1]])
    i, j = np.nonzero(a)
    x = packing.nnls(i, a[i, j], j, 3, np.array([6.0, 4.0]), 4000)
    assert (x >= 0).all() and np.allclose(a @ x, [6, 4], atol=1e-4)


DATA = os.environ.get("TIDEMARK_TEST_DATA", "/root/testdata/sf0.01")
BODY = ["The court below held that the lease had lapsed; we agree.", "Counsel for {n} relied on No. {d}, but that case concerned a void deed.", "The sum of £{d} became due on {d} May 2001, as the levy shows.", "Nothing in exhibits {d} suggests that the guarantee remains enforceable."]
ENDS = ["Order accordingly.", "The appeal is dismissed.", "We would remit the matter to {n}.", "IT IS SO ORDERED", "Costs in the cause"]
BEHIND = ["", "\n\n(signed) Oduvale, presiding", "\n\n* * *", "\nPage 3 of 3", "\n[…]"]


def test_truncation_against_planted_cuts(spark):
    """Texts that stop within a sentence are found, whatever is behind the break; ones that end with a whole sentence, with
    or without a known ending, are not."""
    rng = random.Random(6)
    fill = lambda s: s.format(n=rng.choice(["Marrow", "Lorben Quay", "Ickhaven"]), d=rng.randrange(1, 9999))
    rows, cut = [], set()
    for k in range(1500):
        t = "\n\n".join(" ".join(fill(rng.choice(BODY)) for _ in range(3)) for _ in range(rng.randrange(1, 4)))
        if k % 10 == 0:
            cut.add(k)
            more = fill(rng.choice(BODY))
            rows.append((k, t + " " + more[: rng.randrange(2, len(more) - 2)] + rng.choice([*BEHIND, " [more]", "..."]), "s1"))
        elif k % 10 == 1:
            rows.append((k, t + rng.choice(BEHIND), "s2"))
        else:
            rows.append((k, t + rng.choice(["\n\n", " "]) + fill(rng.choice(ENDS)) + rng.choice(BEHIND), "s2"))
    rows += [(9001, None, "s1"), (9002, "", "s1"), (9003, " \n ", "s1"), (9004, "* * *", "s1"), (0, rows[0][1], "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").cache()
    ends = truncation.endings(df, "doc_id", "text", ["source"]).cache()
    judged = truncation.truncated(ends, "doc_id", ["source"]).collect()
    got = {r.doc_id for r in judged if r.cut}
    assert len(got - cut) <= 0.02 * len(cut)
    assert len(cut - got) <= 0.04 * len(cut)
    assert len(judged) == 1502 and not {r.doc_id for r in judged} & {9001, 9002, 9003}
    assert truncation.truncated(ends.limit(0), "doc_id", ["source"]).count() == 0
    df.unpersist()


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, name):
    import duckdb

    duck = duckdb.connect()
    duck.sql(f"create view documents as select * from '{DATA}/documents.parquet'")
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.sql(SQL[name]).df()
    plain = lambda df: sorted(map(str, df[sorted(want.columns)].itertuples(index=False, name=None)))
    assert sorted(got.columns) == sorted(want.columns) and plain(got) == plain(want)


def test_texts_of_nothing_but_blanks_and_marks(spark):
    """A blank text has no line; a text of one very long word, and one of marks nobody knows, are judged as whole."""
    df = spark.createDataFrame([(1, "\n \t\n"), (2, "…"), (3, "x" * 20000), (4, None)], "doc_id long, text string")
    ends = truncation.endings(df, "doc_id", "text", []).cache()
    assert {r.doc_id: r.lines for r in ends.collect()} == {1: [], 2: ["…"], 3: ["x" * 20000]}
    assert {r.doc_id for r in truncation.truncated(ends, "doc_id", []).where("not cut").collect()} == {2, 3}
