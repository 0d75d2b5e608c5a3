"""The numbered queries against brute force, round trips and held-out labels."""

import base64
import collections
import contextlib
import gzip
import hashlib
import io
import itertools
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fleetscope.llm import decontaminate, media, near_copies, packing, queries, secrets, sharding, simhash, token_counts, token_files, tokens, toxicity, url_filter

SF = "/root/testdata/sf0.001"
NAMES = ("byte_bpe_50k.json", "word_bpe_49k.json")
ODD_TEXT = st.text(st.sampled_from(list("aBé ß\n\t\x1c\xa0²9_-…日İΣ\r😀\x00'sll<|>")), max_size=40)


@pytest.mark.parametrize("name", NAMES)
@settings(max_examples=150, deadline=None)
@given(text=ODD_TEXT)
def test_memo_equals_library(name, text):
    want = tokens.encoder(public_tokenizers.path(name))._whole(text)
    assert tokens.encoder(public_tokenizers.path(name)).encode(text) == want
    if "\x1c" not in text or name.startswith("word"):
        assert token_counts.counter(public_tokenizers.path(name)).count(text) == len(want) // 4


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=700))
def test_blocks_round_trip(ids):
    assert token_files.unpack_ids(token_files.pack_ids(np.asarray(ids, "<u4"))).tolist() == ids


def test_token_queries(spark, texts):
    tok = {n: Tokenizer.from_file(public_tokenizers.path(n)) for n in NAMES}
    at, files = 0, {r["doc_id"]: r for r in queries.op5_token_files(spark, SF).collect()}
    counts = {r["doc_id"]: r for r in queries.op9_token_counts(spark, SF).collect()}
    lengths = collections.Counter()
    sequences = collections.defaultdict(list)
    for r in queries.op10_packing(spark, SF).collect():
        lengths[r["doc_id"]] += r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for doc_id in sorted(texts):
        text = texts[doc_id] or ""
        ids = tok[NAMES[0]].encode(text, add_special_tokens=False).ids + [2]
        r = files[doc_id]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes()))
        at += len(ids)
        n = len(tok[NAMES[1]].encode(text, add_special_tokens=False).ids)
        assert (counts[doc_id]["n_bytes"], counts[doc_id]["n_tokens"], counts[doc_id]["over_limit"]) == (len(text.encode()), n, n > 2048)
        assert lengths[doc_id] == n + 1
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 4096
    assert len(sequences) <= -(-sum(lengths.values()) // 4096) + 1


def slow_print(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, distance):
    least, names = {}, sorted(set(prints.values()))
    parent = {p: p for p in names}

    def find(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            if (a ^ b).bit_count() <= distance:
                parent[find(a)] = find(b)
    for doc_id, p in prints.items():
        least[find(p)] = min(doc_id, least.get(find(p), doc_id))
    return {doc_id: least[find(p)] for doc_id, p in prints.items()}


def test_simhash_query(spark, texts):
    prints = {d: slow_print(t) for d, t in texts.items()}
    want = components(prints, 4)
    for r in queries.op3_simhash(spark, SF).collect():
        assert (r["fingerprint"], r["component_id"]) == (f"{prints[r['doc_id']]:016x}", want[r["doc_id"]])


def test_blocks_are_dealt_anew_without_losing_links(spark, monkeypatch):
    rng = np.random.default_rng(1)
    base = [int(x) for x in rng.integers(0, 2**63, 40)]
    prints = {k: base[k % 40] ^ sum(1 << int(b) for b in rng.integers(0, 64, k % 6)) for k in range(900)}
    monkeypatch.setattr(simhash, "BLOCK_NODES", 12)
    nodes = spark.createDataFrame([(k, simhash.signed(p)) for k, p in prints.items()], "doc_id long, print long").groupBy("print").agg({"doc_id": "min"}).toDF("print", "least")
    linked = simhash.smallest_reachable(nodes, simhash.block_links(simhash.with_pivots(nodes), 4))
    got = {r["print"]: r["component_id"] for r in nodes.join(linked, "print", "left").selectExpr("print", "coalesce(component_id, least) component_id").collect()}
    assert {k: got[simhash.signed(p)] for k, p in prints.items()} == components(prints, 4)


def test_sharding(spark, texts):
    by = collections.defaultdict(list)
    for r in queries.op4_sharding(spark, SF).collect():
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 16, zlib.crc32(raw), "rows", None)
        by[r["shard"]].append(r["slot"])
    assert len(by) == 40
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in by.values())


def test_a_new_shard_moves_few_keys():
    counts = {int(s): 3 for s in range(0, sharding.SLOTS, 97)}
    total = sum(counts.values())

    def shards(n):
        return {(slot, k): shard for slot, a, b, shard, _ in sharding.place(counts, [-(-total * 5 // (4 * n))] * n) for k in range(a, b)}

    a, b = shards(40), shards(41)
    assert sum(a[k] != b[k] for k in a) < 0.15 * total


def test_secrets(spark, texts):
    for r in queries.op2_secret_scan(spark, SF).collect():
        text = texts[r["doc_id"]] or ""
        assert r["base_sha256"] == hashlib.sha256(secrets.told(secrets.scan(text)).encode()).hexdigest()
        assert r["n_hex"] == sum(len(m) >= 16 for m in re.findall("[0-9a-f]+", text))


def test_layers():
    import base64
    import gzip
    from urllib.parse import quote

    secret = 'password = "hunter2hunter2"'
    wrapped = base64.b64encode(gzip.compress(quote(secret, safe="").encode())).decode()
    text = f"before {wrapped} after"
    spans = secrets.secret_spans(text)[1]
    assert (7, 0, 7 + len(wrapped)) in spans
    escaped = "x p\\u0061ssword%20=%20abcdefghijklmnop y"
    assert any(kind == 0 and start == 2 for start, kind, _ in secrets.secret_spans(escaped)[1])
    assert secrets.redacted(text) == "before [SECRET] after"
    assert secrets.secret_spans("%2525" * 50)[3] == 0  # ends


def test_layers_in_wrapped_lines_urls_and_quoted_bytes():
    import base64
    import gzip
    import textwrap
    from urllib.parse import quote

    secret = 'filler words first, so that the lines are long enough; password = "hunter2hunter2hunter2" and then some more words to wrap'
    found = lambda text: any(kind == 0 for _, kind, _ in secrets.secret_spans(text)[1])
    plain, packed = base64.b64encode(secret.encode()).decode(), base64.b64encode(gzip.compress(secret.encode())).decode()
    for width in (64, 76):
        for payload in (plain, packed):
            for sep in ("\n", "\r\n"):
                assert found("before\n\n" + sep.join(textwrap.wrap(payload, width)) + "\n\nafter"), (width, payload)
                assert "hunter2" not in (secrets.redacted(sep.join(textwrap.wrap(payload, width))) or "")
    short = base64.b64encode(b"password=hunter2hunter2").decode()
    for url in (f"https://h.example/files/{short}", f"https://h.example/files/{short}/raw", f"https://h.example/a_b-{packed}"):
        assert found(url), url
    assert found("https://h.example/?q=" + quote(gzip.compress(secret.encode()), safe=""))
    assert found("%FF%70assword%3Dhunter2hunter2")


def test_layers_of_many_members_utf16_binary_and_large_data():
    import base64
    import bz2
    import gzip
    import lzma
    import time
    import zlib as z

    import zstandard

    secret = b'filler and more filler; password = "hunter2hunter2" and so on'
    found = lambda data: any(kind == 0 for _, kind, _ in secrets.secret_spans(f"before {base64.b64encode(data).decode()} after")[1])
    zstd = zstandard.ZstdCompressor().compress
    for pack in (gzip.compress, bz2.compress, lzma.compress, zstd, z.compress):
        assert found(pack(secret)), pack
        assert found(pack(b"nothing here " * 9) + pack(secret)), pack
        assert found(pack(pack(secret))), pack
    assert found(secret.decode().encode("utf-16")) and found(secret.decode().encode("utf-16-be"))
    assert found(b"\x00\x01\xff" + secret + b"\x00")
    assert found(gzip.compress(b"word " * 4_000_000 + secret))
    cut = base64.b64encode(gzip.compress(secret + np.random.default_rng(0).bytes(5000))[:-2000]).decode()
    assert secrets.secret_spans(cut)[3] == 1 and found(base64.b64decode(cut))
    began = time.process_time()
    text = "%2541 \\u0061 " * 20_000 + "%2570assword%253Dhunter2hunter2"
    assert secrets.secret_spans(text)[1] and time.process_time() - began < 20


def brute_base(text):
    """The base spans of the contract, by its patterns as they stand."""
    text, out = text or "", []
    for kind, pattern, group, least in (("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12), ("access", "AKIA[A-Z0-9]+", 0, 18), ("hex", "[0-9a-f]+", 0, 16)):
        out += [(m.start(), ["assign", "access", "hex"].index(kind), kind, m.end()) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in sorted(out))


def test_base_spans_by_the_patterns_as_they_stand(spark, texts):
    for r in queries.op2_secret_scan(spark, SF).collect():
        assert r["base_sha256"] == hashlib.sha256(brute_base(texts[r["doc_id"]]).encode()).hexdigest()


def test_url_rules_and_model(spark):
    rules = queries.RULES
    model = url_filter.train(url_filter.seed_urls(spark))
    pages = [(1, "http://WWW.a.example.com/en/1?x"), (2, "http://a.example.com/en/1"), (3, "https://x.net/fr/1#t"), (4, None), (5, "no scheme"), (6, "http://x.com"), (7, "http://www.example.com/en/"), (8, "https://big-casino-win.example.org/q/1"), (9, "https://weather-history.example.org/q/1")]
    got = {r["page_id"]: r for r in url_filter.judge_urls(spark.createDataFrame(pages, "page_id long, url string"), rules, model).collect()}
    assert [(got[k]["rule"], got[k]["verdict"]) for k in (1, 2, 3, 7)] == [("example.com/en/", "block"), ("example.com/en/", "block"), ("net/fr/", "block"), ("www.example.com/en/", "allow")]
    assert (got[1]["host"], got[1]["path"]) == ("www.a.example.com", "/en/1")
    assert all((got[k]["host"], got[k]["path"]) == ("", "") for k in (4, 5))
    assert got[6]["rule"] is None
    assert (got[8]["verdict"], got[9]["verdict"]) == ("block", "allow")


def test_media_round_trips():
    rng = np.random.default_rng(0)
    gray = rng.integers(0, 256, (13, 9)).astype(np.uint8)
    assert (media.decode(media.encode_pgm(gray)) == gray).all()
    assert (media.decode(media.encode_bmp(gray)) == gray).all()
    assert media.decode(b"P2\n# c\n2 1\n255\n7 9\n").tolist() == [[7, 9]]
    assert media.decode(b"P4\n3 1\n\xa0").tolist() == [[0, 1, 0]]
    small = media.area_resize(gray, 1, 1)
    assert np.isclose(small[0, 0], gray.mean())
    exact = np.kron(np.arange(6).reshape(2, 3), np.ones((4, 5)))
    assert np.allclose(media.area_resize(exact, 2, 3), np.arange(6).reshape(2, 3))


def slow_resize(gray, height, width):
    """Each target cell's mean by weights of every source sample."""
    share = lambda n, cells: np.asarray([[max(0.0, min(k + 1, (c + 1) * n / cells) - max(k, c * n / cells)) for k in range(n)] for c in range(cells)])
    return share(gray.shape[0], height) @ gray @ share(gray.shape[1], width).T * (height * width / gray.size)


def test_media_query(spark, texts):
    for r in queries.op7_media(spark, SF).collect():
        raw = (texts[r["doc_id"]] or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        assert (r["n_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        stored = b"P5\n64 %d\n255\n" % (len(payload) // 64) + payload
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        if len(raw) < 3000:
            gray = np.frombuffer(payload, np.uint8).reshape(-1, 64).astype(float)
            small = np.round(slow_resize(gray, 8, 9), 6)
            assert r["feature"] == np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()
            tile = np.load(io.BytesIO(media.npy_tile(gray)))
            assert np.abs(tile - slow_resize(gray, *tile.shape)).max() <= 0.5 + 1e-6


def test_long_images_are_summed_in_bands(monkeypatch):
    gray = np.random.default_rng(5).integers(0, 256, (5000, 64)).astype(np.uint8)
    whole = media.area_resize(gray, 16, 16)
    monkeypatch.setattr(media, "BAND_SAMPLES", 1000)
    assert np.allclose(media.area_resize(gray, 16, 16), whole) and np.allclose(whole, slow_resize(gray.astype(float), 16, 16))


def test_decontamination_tolerates_replaced_words(spark):
    item = "the quick brown fox jumps over a very lazy dog while seven grey geese fly south for winter"
    words = item.split()
    changed = " ".join("zebra" if k in (3, 11) else w for k, w in enumerate(words))
    docs = [(1, f"x y z {item} tail"), (2, f"head {changed} tail"), (3, "nothing to see here at all"), (4, " ".join(words[:6])), (5, None)]
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(9, item), (10, None), (11, "short")], "item_id long, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"], r["equal_words"]) for r in got) == [(1, 9, len(words)), (2, 9, len(words) - 2)]


def windows_overlap(doc, item):
    """Whether any 13 or more words of ``doc``, or all of a shorter item's, equal ``item``'s in 0.8 of the places; over all windows."""
    need = min(13, len(item))
    for shift in range(-len(item), len(doc)):
        equal = [doc[k + shift] == w for k, w in enumerate(item) if 0 <= k + shift < len(doc)]
        if any(5 * sum(equal[a:b]) >= 4 * (b - a) for a in range(len(equal)) for b in range(a + need, len(equal) + 1)):
            return True
    return False


def replaced(rng, words, n):
    out = list(words)
    for k in rng.choice(len(words), n, replace=False):
        out[k] = f"zebra{k}"
    return out


def decontamination_case(spark, lengths_and_changes):
    rng, items, docs = np.random.default_rng(8), {}, {}
    for n, changes in lengths_and_changes:
        for _ in range(12):
            i = len(items)
            items[i] = [f"i{i}w{k}" for k in range(n)]
            docs[i] = [*(f"d{i}a{k}" for k in range(5)), *replaced(rng, items[i], changes), *(f"d{i}b{k}" for k in range(40))]
    frame = lambda t, name: spark.createDataFrame([(k, " ".join(w)) for k, w in t.items()], f"{name} long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(frame(docs, "doc_id"), frame(items, "item_id")).collect()}
    return got, {(i, i) for i in items if windows_overlap(docs[i], items[i])}


@pytest.mark.parametrize("filtered", [True, False])
def test_decontamination_finds_every_window(spark, monkeypatch, filtered):
    if not filtered:
        monkeypatch.setattr(decontaminate, "MOST_FILTER", 0)
    got, want = decontamination_case(spark, [(13, 1), (60, 15), (100, 25)])
    assert len(want) > 24 and got == want


def test_seeds_hit_every_overlap():
    def hit(equal, masks, places):
        return any(all(equal[at + k] for k, c in enumerate(mask) if c == "#") for mask in masks for at in places(len(equal) - len(mask) + 1))

    for n in range(13, 26):
        others = n // 5
        for gone in itertools.combinations(range(n), others):
            equal = [k not in gone for k in range(n)]
            assert hit(equal, decontaminate.MASKS, range), (n, gone)
    for n in range(decontaminate.LEAST_ITEM, 13):
        for gone in itertools.combinations(range(n), n // 5):
            assert hit([k not in gone for k in range(n)], decontaminate.short_masks(n), lambda _: [0]), (n, gone)


@pytest.mark.parametrize("filtered", [True, False])
def test_decontamination_finds_short_and_much_changed_items(spark, monkeypatch, filtered):
    if not filtered:
        monkeypatch.setattr(decontaminate, "MOST_FILTER", 0)
    got, want = decontamination_case(spark, [(13, 2), (15, 3), (16, 3), *((n, n // 5) for n in range(3, 13)), (8, 2)])
    assert len(want) == 13 * 12 and got == want


def test_one_row_for_a_document_that_meets_an_item_on_every_diagonal(spark):
    items = spark.createDataFrame([(1, "same " * 30), (2, "alone"), (3, "two words")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "same " * 8000), (1, "same " * 8000), (2, "not alone here"), (3, "those two words there"), (4, "same")], "doc_id long, text string")
    got = {(r["doc_id"], r["item_id"]): tuple(r)[2:] for r in decontaminate.contaminated(docs, items).collect()}
    # Each end keeps the diagonals that still hold 13 of the item's words.
    assert got == {(1, 1): (30, 30, 8000 - 30 + 1 + 2 * (30 - 13))}
    assert set(map(lambda r: (r["doc_id"], r["item_id"]), decontaminate.contaminated(docs, items, least_item=1).collect())) == {(1, 1), (2, 2), (3, 3)}


def test_long_base64_and_its_breaks_take_time_in_their_length():
    began = time.time()
    noise = base64.b64encode(np.random.default_rng(1).bytes(750_000)).decode()
    assert secrets.secret_spans(noise)[0] == []
    assert secrets.secret_spans("YWI/" * 50_000)[0] == []
    assert secrets.secret_spans("H4sI/" * 20_000)[0] == []
    assert time.time() - began < 20
    inside = base64.b64encode(b"say " * 100_000 + b"password=abcdefghijkl1").decode()
    base, spans, layers, unread = secrets.secret_spans(f"<img {inside}>")
    assert [(a, k, b) for a, k, b in spans if (a, k, b) not in base] == [(5, 0, 5 + len(inside))] and unread == 0


def peeled(text, depth=4):
    """Every text that decoding whole runs of one encoding, or one base64 word, can give within some steps."""
    seen, front = {text}, {text}
    for _ in range(depth):
        found = set()
        for t in front:
            found.add(re.sub(r"(?:%[0-9A-Fa-f]{2})+", lambda m: bytes.fromhex(m[0].replace("%", "")).decode(errors="replace"), t))
            found.add(re.sub(r"(?:\\u[0-9A-Fa-f]{4})+", lambda m: m[0].encode().decode("unicode_escape"), t))
            for m in re.finditer(r"[A-Za-z0-9+/]{16,}={0,2}", t):
                with contextlib.suppress(ValueError):
                    data = base64.b64decode(m[0] + "=" * (-len(m[0]) % 4), validate=True)
                    if data[:2] == b"\x1f\x8b":
                        data = gzip.decompress(data)
                    if all(32 <= b < 127 for b in data):
                        found.add(data.decode())
        front = found - seen
        seen |= found
    return seen


@pytest.mark.parametrize("seed", range(40))
def test_secrets_under_random_layers_equal_plain_peeling(seed):
    """Random nests of encodings: a secret is found if and only if peeling in every way shows it, and its span holds the outermost code of it."""
    rng = np.random.default_rng(seed)
    wraps = [lambda t: base64.b64encode(t.encode()).decode(), lambda t: base64.b64encode(gzip.compress(t.encode(), mtime=0)).decode(), lambda t: "".join(f"%{b:02X}" for b in t.encode()), lambda t: "".join(f"\\u{ord(c):04x}" for c in t)]
    coded = "password=abcdefghijkl" + str(seed) if rng.random() < 0.7 else "nothing to be found in here"
    hidden = coded
    for k in rng.integers(0, 4, int(rng.integers(1, 4))).tolist():
        coded = wraps[k](coded)
    text = f"before ({coded}) after"
    base, spans, _, unread = secrets.secret_spans(text)
    shown = any("password=" in t for t in peeled(text))
    assert shown == ("password=" in hidden) == any(k == 0 for _, k, _ in spans) and not unread
    assert all(a >= 8 and b <= 8 + len(coded) for a, k, b in spans if k == 0)


def test_best_fit_respects_every_capacity():
    lengths = np.sort(np.random.default_rng(2).integers(1, 60, 300))[::-1]
    capacity = packing.Capacity(100, 4, 4000)
    bins, offsets = packing.best_fit(lengths, capacity)
    for b in np.unique(bins):
        own = lengths[bins == b]
        assert own.sum() <= 100 and len(own) <= 4 and (own**2).sum() <= 4000
        assert sorted(offsets[bins == b]) == np.concatenate([[0], np.cumsum(own[np.argsort(offsets[bins == b])])[:-1]]).tolist()


def test_label_model_finds_good_voters():
    rng = np.random.default_rng(3)
    y = rng.random(4000) < 0.1
    votes = np.column_stack([rng.random(4000) < np.where(y, 0.7, 0.001) for _ in range(4)] + [rng.random(4000) < 0.001])
    counts = collections.Counter((votes @ (1 << np.arange(5))).tolist())
    model = toxicity.fit_label_model(counts, 5)
    p = model.posterior(votes.astype(float))
    assert ((p > 0.5) == y).mean() > 0.98


def test_toxicity_query(spark):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = queries.op6_toxicity(spark, SF).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    wrong = sum(r["predicted"] and not labels[r["doc_id"]] for r in rows if r["doc_id"] in labels)
    assert wrong <= 2


def test_odd_rows(spark, odd):
    path = public_tokenizers.path(NAMES[1])
    n = odd.count()
    labels = spark.createDataFrame([(4, 1, 0), (None, 0, 1), (5, None, None)], "doc_id long, toxic int, quality int")
    items = spark.createDataFrame([(1, "one two"), (None, "x")], "item_id long, text string")
    assert token_counts.token_counts(odd, path).count() == n
    assert sharding.shard_rows(odd, 3).count() == n
    assert simhash.near_duplicates(odd).count() == n
    assert secrets.secret_scan(odd).count() == n
    assert media.media_features(media.store_texts(odd)).count() == n
    assert token_files.read_token_files(token_files.write_token_files(odd, path, 2)).count() == n
    assert packing.pack_documents(odd, path, 1).groupBy("doc_id").count().count() == 7
    assert toxicity.score(odd, toxicity.train(odd, labels)).count() == n
    assert decontaminate.contaminated(odd, items).count() == 0
    empty = odd.limit(0)
    for made in (token_counts.token_counts(empty, path), sharding.shard_rows(empty, 3), simhash.near_duplicates(empty), secrets.secret_scan(empty), packing.pack_documents(empty, path, 1), decontaminate.contaminated(empty, items.limit(0)), toxicity.score(empty, toxicity.train(empty, labels.limit(0)))):
        assert made.count() == 0


def test_best_fit_weighs_what_is_left():
    """Two open sequences fit the piece; the weights choose the one with fewer documents or with fewer tokens left."""
    lengths = np.asarray([60, 20, 20, 15])
    by_tokens, _ = packing.best_fit(lengths, packing.Capacity(100, 3, 10**6, (1.0, 0.0, 0.0)))
    assert by_tokens.tolist() == [0, 0, 0, 1]
    narrow, _ = packing.best_fit(lengths, packing.Capacity(100, 2, 10**6, (1.0, 0.0, 0.0)))
    assert narrow.tolist() == [0, 0, 1, 1]


def test_packed_pieces_are_the_librarys_ids(spark, texts):
    tok = Tokenizer.from_file(public_tokenizers.path(NAMES[1]))
    want = {}
    for doc_id, text in texts.items():
        ids = tok.encode(text or "", add_special_tokens=False).ids + [1]
        for piece, start in enumerate(range(0, len(ids), 4096)):
            part = ids[start : start + 4096]
            want[doc_id, piece] = (start, len(part), zlib.crc32(np.asarray(part, "<u4").tobytes()))
    rows = queries.op10_packing(spark, SF).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want and len(rows) == len(want)


def test_url_model_against_its_formula(spark):
    """The score of every sf0.001 page by a plain sum over the buckets that the operator hashes its n-grams to."""
    from pyspark.sql import functions as F

    model = url_filter.train(url_filter.seed_urls(spark))
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    judged = url_filter.judge_urls(pages, queries.RULES, model)
    buckets = judged.select("page_id", "score", "rule", "verdict", url_filter.ngram_buckets(F.col("host"), F.col("path")).alias("b"))
    for r in buckets.collect():
        margin = model.bias + sum(model.weights[k] for k in r["b"]) / max(1, len(r["b"])) ** 0.5
        assert abs(r["score"] - 1 / (1 + np.exp(-margin))) < 1e-6
        if r["rule"] is None:
            assert r["verdict"] == ("block" if r["score"] >= model.threshold else "allow")


def test_clashing_columns_and_very_long_texts(spark):
    rng = np.random.default_rng(6)
    long = " ".join(f"w{k}" for k in rng.integers(0, 10**6, 60_000))
    rows = [(1, long, 7), (2, long + " more", 7), (3, "short text here", 7), (None, None, None), (3, "short text here", 7)]
    docs = spark.createDataFrame([(*r, r[2], r[2]) for r in rows], "doc_id long, text string, gone_id long, own_0 long, row long")
    items = spark.createDataFrame([(1, " ".join(long.split()[500:530]))], "item_id long, text string")
    kept = near_copies.drop_near_copies(docs)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "3", "None"]
    clean = decontaminate.drop_contaminated(docs, items)
    assert clean.columns == docs.columns and sorted(str(r["doc_id"]) for r in clean.collect()) == ["3", "3", "None"]
    pages = spark.createDataFrame([(1, "http://h.com/" + "a/" * 50_000)], "page_id long, url string")
    assert url_filter.judge_urls(pages, queries.RULES, url_filter.train(url_filter.seed_urls(spark))).first()["path"] == "/" + "a/" * 50_000
    assert url_filter.judge_urls(pages.limit(0), queries.RULES, url_filter.train(url_filter.seed_urls(spark))).count() == 0


def test_many_rows_of_one_id(spark):
    docs = spark.range(3000).selectExpr("5L AS doc_id", "concat('text ', id % 700) AS text")
    path = public_tokenizers.path(NAMES[0])
    rows = token_files.read_token_files(token_files.write_token_files(docs, path, 2)).collect()
    starts = sorted((r["start"], r["n_tokens"]) for r in rows)
    assert len(rows) == 3000 and [s for s, _ in starts] == np.cumsum([0, *(n for _, n in starts[:-1])]).tolist()
    placed = sharding.shard_rows(docs, shards=7).groupBy("shard").count().collect()
    assert sorted(r["count"] for r in placed) == [428, 428, 428, 429, 429, 429, 429]


def test_toxicity_by_folds_of_the_rows_it_may_learn_from(spark):
    """Rows that are held out play no part: each fold of the others is scored by a model of the rest."""
    from pyspark.sql import functions as F

    sf = SF.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    part, truth = F.crc32(F.col("doc_id").cast("string")) % 4, {r["doc_id"]: r["toxic"] for r in labels.collect()}
    got = []
    for k in (0, 1, 3):
        model = toxicity.train(docs, labels.where(part != k))
        got += [(truth[r["doc_id"]], r["predicted"]) for r in toxicity.score(docs.where(part == k), model).collect() if r["doc_id"] in truth]
    found, toxic = sum(p for t, p in got if t), sum(t for t, _ in got)
    assert found >= 0.5 * toxic and sum(p for t, p in got if t == 0) <= 0.01 * len(got)
