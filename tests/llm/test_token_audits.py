"""Byte-level BPE, cross-tokenizer alignment and the source audit against the libraries, brute force and SQL."""

import base64
import collections
import functools
import hashlib
import random

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fleetscope.llm import alignment, byte_bpe, divergence, queries

SF = "/root/testdata/sf0.001"
RANKS, SIDE_A, SIDE_B = (public_tokenizers.path(n) for n in ("byte_bpe_50k.tiktoken", "byte_bpe_50k.json", "piece_bpe_32k.model"))
ODD_TEXT = st.lists(st.sampled_from([*"aBé ß\n\t\x1c\xa0²9_-…日İΣ\r😀\x00'sllrevetmdx<|>᠎ ᛮ", "  ", "'s", "'ll", "'re", "<|endoftext|>", "<s>", "<0x0A>", "<unk>", "▁"]), max_size=60).map("".join)


@pytest.fixture(scope="module")
def library():
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.lists(ODD_TEXT, max_size=6))
def test_ids_equal_library_and_decode(library, texts):
    own = byte_bpe.rank_encoder(RANKS)
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert ids.tolist() == library.encode_ordinary(text)
        assert own.decode(ids) == text.encode()


def test_every_code_point_has_the_librarys_class(library):
    """Each code point between letters, after a space and alone; so a class that differs would part the pieces otherwise."""
    own = byte_bpe.rank_encoder(RANKS)
    points = [chr(c) for c in [*range(0x3000), *range(0xA000, 0xD800), *range(0xE000, 0x12000), *range(0x1D000, 0x1F000)]]
    texts = [f"a{c}a {c} {c}1{c}" for c in points]
    text = "".join(texts)
    assert next(own.encode([text])).tolist() == library.encode_ordinary(text)


def test_scan_over_blocks_equals_steps():
    rng = np.random.default_rng(3)
    for n in (1, 255, 256, 257, 5000):
        symbols = rng.integers(0, 9, n).astype(np.uint8)
        state, want = byte_bpe.CLOSED, []
        for s in symbols:
            want.append(state)
            state = byte_bpe.AFTER[s][state]
        assert byte_bpe.states_before(symbols).tolist() == want


def test_long_pieces_take_time_in_their_length(library):
    own = byte_bpe.rank_encoder(RANKS)
    rng = random.Random(5)
    text = "".join(rng.choice("abcdefgh") for _ in range(100_000))
    assert own.decode(next(own.encode([text]))) == text.encode()
    assert next(own.encode([text[:3000]])).tolist() == library.encode_ordinary(text[:3000])


def test_short_pieces_merge_as_long_ones_do(monkeypatch):
    own, rng = byte_bpe.rank_encoder(RANKS), random.Random(9)
    pieces = ["".join(rng.choice("etaoinsh lr0é.") for _ in range(rng.randrange(2, 48))).encode()[:48] for _ in range(2000)]
    short = [own.merged(p) for p in pieces]
    monkeypatch.setattr(byte_bpe, "SHORT_PIECE", 0)
    assert short == [own.merged(p) for p in pieces]


def test_op12_query(spark, texts, library):
    rows = queries.op12_byte_bpe(spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        text = texts[r["doc_id"]] or ""
        ids = library.encode_ordinary(text)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_encode_odd_rows_and_slices(spark, odd, library):
    made = byte_bpe.encode_texts(odd, RANKS)
    rows = {r["doc_id"]: r for r in byte_bpe.decode_ids(made, RANKS).collect()}
    assert made.count() == odd.count() and rows[1]["n_tokens"] == rows[2]["n_tokens"] == 0 and rows[1]["decoded"] == b""
    assert rows[5]["decoded"] == b"word " * 40_000 and rows[6]["decoded"].decode() == "a\x1cb  c \n d<|endoftext|>é…"
    assert byte_bpe.encode_texts(odd.limit(0), RANKS).count() == 0
    part = {r["doc_id"]: r["decoded"] for r in byte_bpe.decode_ids(made, RANKS, 10, 21).collect()}
    text = b"word " * 40_000
    inside = [k for k, end in enumerate(np.cumsum([len(library.decode_single_token_bytes(i)) for i in library.encode_ordinary(text.decode())])) if end <= 21]
    ids = library.encode_ordinary(text.decode())
    starts = np.cumsum([0] + [len(library.decode_single_token_bytes(i)) for i in ids])
    assert part[5] == b"".join(library.decode_single_token_bytes(ids[k]) for k in inside if starts[k] >= 10)


@functools.cache
def plain_library():
    library = Tokenizer.from_file(SIDE_A)
    library.encode_special_tokens = True
    return library


@settings(max_examples=300, deadline=None)
@given(ODD_TEXT)
def test_sides_equal_libraries(text):
    own = alignment.aligner(SIDE_A, SIDE_B)
    assert np.frombuffer(own.a.encode(text), np.int32).tolist() == plain_library().encode(" " + text, add_special_tokens=False).ids
    if text:
        assert np.frombuffer(own.b.encode(text), np.int32).tolist() == own.b.model.encode(text)


def aligned_by_hand(texts):
    """The measures of every text, group by group and link by link."""
    a, b = plain_library(), sentencepiece.SentencePieceProcessor(model_file=SIDE_B)
    own = alignment.aligner(SIDE_A, SIDE_B)
    found, held_by = [], collections.Counter()
    for text in texts:
        x, y = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        p, q = [own.a.pieces[k] for k in x], [own.b.pieces[k] for k in y]
        if not text or b"".join(p) != b" " + text.encode() or b"".join(q) != b" " + text.encode():
            found.append(None)
            continue
        ends = [list(np.cumsum([len(w) for w in side])) for side in (p, q)]
        groups, low = [], 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            groups.append(tuple([k for k, e in zip(ids, own_ends, strict=True) if low < e <= cut] for ids, own_ends in zip((x, y), ends, strict=True)))
            low = cut
        links = [(i, j) for left, right in groups for i in left for j in right]
        held_by.update(set(links))
        found.append((len(x), len(y), groups, links))
    most = collections.Counter()
    for (i, _), n in held_by.items():
        most[i] = max(most[i], n)
    for f in found:
        if f is None:
            yield 0, 0, 0, 0, 0, 0, ""
        else:
            shown = ";".join("|".join(",".join(map(str, side)) for side in g) for g in f[2])
            yield f[0], f[1], len(f[2]), len(f[3]), sum(held_by[k] == most[k[0]] for k in f[3]), sum(held_by[k] for k in f[3]), hashlib.sha256(shown.encode()).hexdigest()


@pytest.mark.parametrize("block,hot,wide", [(1 << 19, 0.001, 64), (200, 0.9, 1)])
def test_alignment_equals_brute_force(spark, texts, monkeypatch, block, hot, wide):
    for name, value in (("BLOCK_ENTRIES", block), ("HOT_SHARE", hot), ("WIDE_GROUP", wide)):
        monkeypatch.setattr(alignment, name, value)
    rows = [(i, t) for i, t in sorted(texts.items()) if t is None or len(t) < 4000]
    rows += [(9001, None), (9002, ""), (9003, "a"), (9004, "a"), (9004, "a"), (None, "a"), (9005, "▁x"), (9006, "日" * 50 + "  \n \n"), (9007, " " * 300 + "é" * 100), (9008, "a<|endoftext|></s>")]
    docs = spark.createDataFrame([(i, t, 1, b"x") for i, t in rows], "doc_id long, text string, block int, key binary")
    got = sorted((r[0] or 0, *r[1:]) for r in map(tuple, alignment.alignment(docs, SIDE_A, SIDE_B).collect()))
    assert got == sorted((i or 0, *w) for (i, _), w in zip(rows, aligned_by_hand([t for _, t in rows]), strict=True))


def test_alignment_of_odd_and_no_rows(spark, odd):
    assert alignment.alignment(odd, SIDE_A, SIDE_B).count() == odd.count()
    assert alignment.alignment(odd.limit(0), SIDE_A, SIDE_B).count() == 0


def by_sql(documents):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{documents}'")
    return sorted(con.sql(queries.OP13_SQL).fetchall())


def test_divergence_equals_sql(spark):
    assert sorted(map(tuple, queries.op13_divergence(spark, SF).collect())) == by_sql(f"{SF}/documents.parquet")


def test_divergence_odd_rows_equal_sql(spark, tmp_path, monkeypatch):
    """Null and empty columns, copies over sources, flushes in every task, sources without terms, a clashing column."""
    monkeypatch.setattr(divergence, "COMBINE_CHARS", 200)
    monkeypatch.setattr(divergence, "COUNT_ENTRIES", 5)
    monkeypatch.setattr(divergence, "CHECK_ROWS", 2)
    rng = random.Random(1)
    words = ["Ä", "é", "Foo", "bar", "baz\x00qux", "naïve", "x9y", "[a]", "日本"]
    rows = [(rng.choice(["en", "fr", None, ""]), rng.choice(["a", "b", None, "c"]), rng.choice([None, "", " ".join(rng.choices(words, k=rng.randrange(9)))]), 1) for _ in range(900)]
    rows += [("en", "a", "Foo bar Ä", 1)] * 500 + [("zz", s, "rare", 1) for s in "abc"]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "lang string, source string, text string, term int").repartition(3).write.parquet(path)
    docs = spark.read.parquet(path)
    assert sorted(map(tuple, divergence.divergence(docs).collect())) == by_sql(f"{path}/*.parquet")
    assert divergence.divergence(docs.limit(0)).count() == 0


def test_shares_of_very_large_counts_are_exact(spark):
    count, total = 10**15 + 7, 3 * 10**15
    row = spark.range(1).select(divergence.share(*(divergence.F.lit(x).cast("long") for x in (count, total, 11))).alias("p")).first()
    assert row["p"] == 1 + 10**9 * (count + 5) // (total + 55)
