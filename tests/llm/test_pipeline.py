"""The pipeline against brute-force versions of its stages, and each stage on odd rows."""

import collections

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from fleetscope.llm import decontaminate, near_copies, secrets, simhash, toxicity

SF = "/root/testdata/sf0.001"


def shingles(text, n=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))}


def near_copy_groups(texts, least=0.8):
    sets, parent = {d: shingles(t) for d, t in texts.items()}, {d: d for d in texts}

    def find(d):
        while parent[d] != d:
            d = parent[d]
        return d

    holders = collections.defaultdict(list)
    for d, own in sets.items():
        for s in own:
            holders[s].append(d)
    for a, b in {(a, b) for own in holders.values() for a in own for b in own if a < b}:
        if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in texts}


def leaking(texts, items):
    """Ids of texts with a window on any diagonal of any item in which 0.8 of the places are equal, over all windows."""
    hashed, out = {i: decontaminate.word_hashes(t) for i, t in items.items()}, set()
    places = collections.defaultdict(list)
    for i, words in hashed.items():
        for k, w in enumerate(words.tolist()):
            places[w].append((i, k))
    for d, text in texts.items():
        doc = decontaminate.word_hashes(text)
        diagonals = collections.Counter((i, at - k) for at, w in enumerate(doc.tolist()) for i, k in places.get(w, ()))
        for (i, shift), n in diagonals.items():
            if n >= 6:
                item = hashed[i].tolist()
                equal = [int(0 <= k + shift < len(doc) and doc[k + shift] == w) for k, w in enumerate(item)]
                sums, need = np.cumsum([0, *equal]), min(13, len(item))
                if any(5 * (sums[b] - sums[a]) >= 4 * (b - a) for a in range(len(equal)) for b in range(a + need, len(equal) + 1)):
                    out.add(d)
    return out


def test_stages_against_brute_force(spark):
    docs, stages = spark.read.parquet(f"{SF}/documents.parquet"), dict(corpus_pipeline.STAGES)
    columns = docs.columns
    text = lambda df: {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}
    before = text(docs)

    clean = stages["toxicity"](spark, docs, SF).cache()
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert clean.columns == columns
    assert set(text(clean)) == {r["doc_id"] for r in toxicity.score(docs, model).where("predicted = 0").collect()}

    groups = near_copy_groups(text(clean))
    apart = stages["near_dedup"](spark, clean, SF).cache()
    assert apart.columns == columns
    assert set(text(apart)) == set(groups.values())

    gone = leaking(text(apart), {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()})
    kept = stages["decontamination"](spark, apart, SF).cache()
    assert kept.columns == columns and gone
    assert set(text(kept)) == set(text(apart)) - gone

    masked = stages["secret_scan"](spark, kept, SF).cache()
    after = text(masked)
    assert masked.columns == columns and set(after) == set(text(kept))
    for d, t in after.items():
        assert not secrets.scan(t or "")
        if not secrets.secret_spans(before[d])[1]:
            assert t == before[d]
    assert all(r["n_chars"] == len(r["text"]) for r in masked.where("text is not null").collect())

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lengths, sequences = collections.Counter(), collections.defaultdict(list)
    for r in stages["packing"](spark, masked, SF).collect():
        lengths[r["doc_id"]] += r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert lengths == {d: len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for d, t in after.items()}
    for parts in sequences.values():
        parts.sort()
        assert [o for o, _ in parts] == np.cumsum([0, *(n for _, n in parts[:-1])]).tolist() and sum(n for _, n in parts) <= 4096
    assert sum(r["length"] for r in corpus_pipeline.run(spark, SF).collect()) == sum(lengths.values())


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_keep_odd_rows(spark, odd, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    got = stage(spark, odd, SF)
    assert stage(spark, odd.limit(0), SF).count() == 0
    if name == "packing":
        assert {r["doc_id"] for r in got.select("doc_id").distinct().collect()} == {None, 1, 2, 3, 4, 5, 6}
        return
    assert got.columns == odd.columns
    # Texts without words are equal and so are repeated texts: the smallest id of each stays, and rows without an id.
    ids = collections.Counter(r["doc_id"] for r in got.select("doc_id").collect())
    everything = collections.Counter(r["doc_id"] for r in odd.select("doc_id").collect())
    assert ids == (collections.Counter({1: 1, 4: 2, None: 2, 5: 1, 6: 1}) if name == "near_dedup" else everything)


def test_near_copies_of_one_group(spark):
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in rng.integers(0, 5000, 400)]
    texts = {0: " ".join(words)}
    for d in range(1, 40):
        own = list(words)
        own[int(rng.integers(0, 400))] = f"new{d}"
        texts[d] = " ".join(own)
    texts |= {100 + k: " ".join(f"v{x}" for x in rng.integers(0, 5000, 300)) for k in range(20)}
    found = near_copies.near_copies(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == near_copy_groups(texts)


@pytest.mark.parametrize(("short", "cell"), [(16, 1024), (2, 1024), (2, 7), (1000, 7)])
def test_near_copies_that_are_close_to_their_base_only(spark, monkeypatch, short, cell):
    """Short lists alone, long lists in one unit, and long lists over many cells give the same groups."""
    monkeypatch.setattr(near_copies, "SHORT_LIST", short)
    monkeypatch.setattr(near_copies, "CELL_NODES", cell)
    rng = np.random.default_rng(6)
    texts = {}
    for group in range(6):
        words = [f"g{group}w{k}" for k in rng.permutation(200)]
        texts[100 * group + 50] = " ".join(words)
        for d in range(30):
            own = list(words)
            for at in rng.choice(200, 4, replace=False):
                own[int(at)] = f"new{group}x{d}x{at}"
            texts[100 * group + d + (d >= 25) * 30] = " ".join(own)
    found = near_copies.near_copies(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == near_copy_groups(texts)


def test_near_copies_without_a_first_pass(spark, monkeypatch):
    """The exact part alone, with every table joined by a shuffle."""
    monkeypatch.setattr(near_copies, "MOST_BROADCAST", 0)
    rng = np.random.default_rng(9)
    words = [f"w{k}" for k in range(120)]
    texts = {}
    for d in range(60):
        own = list(words)
        for at in rng.choice(120, int(rng.integers(0, 7)), replace=False):
            own[int(at)] = f"new{d}x{at}"
        texts[d] = " ".join(own)
    found = near_copies.near_copies(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), distance=0)
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == near_copy_groups(texts)


def test_first_pass_deals_each_fingerprint_a_fixed_number_of_times(spark, monkeypatch):
    """Blocks that texts which are not alike would fill are parted by more bits, not dealt anew by every part of the rest."""
    rng, rows = np.random.default_rng(8), []
    counted = lambda cut: lambda df: rows.append((out := cut(df)).count()) or out
    monkeypatch.setattr(simhash, "BLOCK_NODES", 2)
    for module in (simhash, near_copies):
        monkeypatch.setattr(module, "cut", counted(module.cut))
    texts = {k: " ".join(f"v{x}" for x in rng.integers(0, 5000, 60)) for k in range(400)}
    found = near_copies.near_copies(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert all(r["doc_id"] == r["component_id"] for r in found.collect()) and max(rows) <= 2 * len(texts)


def test_frequent_shingles_are_told_from_a_share_of_all_texts(spark, monkeypatch):
    """A shingle that one text in ten holds counts as frequent however many texts there are, beside a small least number of them."""
    monkeypatch.setattr(near_copies, "SAMPLE_DOCS", 20)
    texts = spark.range(4000).selectExpr("concat_ws(' ', concat('u', id), if(id % 10 = 0, 'a b c d e', concat('v', id)), concat('w', id)) text")
    hashes, counts = near_copies.frequent_shingles(texts, 5)
    line = near_copies.shingle_hashes(near_copies.hashed_words([b"a", b"b", b"c", b"d", b"e"])[0], 5)
    assert hashes.tolist() == line.tolist() and counts[0] >= 10


def test_first_pass_links_what_is_alike(spark):
    rng = np.random.default_rng(9)
    prints = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    for k in range(0, 3000, 2):
        prints[k + 1] = prints[k] ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 63, 4).astype(np.uint64))
    prints[:400] = prints[0] ^ (np.uint64(1) << rng.integers(0, 63, 400).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 63, 400).astype(np.uint64))
    own = sorted({int(x) for x in prints})
    nodes = spark.createDataFrame([(x, x) for x in own], "print long, least long")
    links = near_copies.print_links(nodes.select("print"), 8).collect()
    assert all(0 < (a ^ b).bit_count() <= 8 for a, b in links)
    group = {r["print"]: r["component_id"] for r in simhash.smallest_reachable(nodes, spark.createDataFrame(links, "a long, b long")).collect()}
    assert len({group.get(int(x)) for x in prints[:400]}) == 1 and None not in {group.get(int(x)) for x in prints[:400]}
    joined = [group.get(int(prints[k])) == group.get(int(prints[k + 1]), -1) for k in range(400, 3000, 2)]
    assert np.mean(joined) > 0.95


def test_near_copies_by_contiguous_edits(spark):
    rng = np.random.default_rng(7)
    texts, d = {}, 0
    for n in (150, 400):
        for k in range(60):
            words = [f"v{x}" for x in rng.integers(0, 100_000, n)]
            more = [f"u{x}" for x in rng.integers(0, 100_000, n)]
            cut = int(n * (0.1 + 0.14 * rng.random()))
            at = int(rng.integers(0, n - cut // 2))
            other = (words + more[:cut], words[: n - cut], words[:at] + more[: cut // 2] + words[at + cut // 2 :])[k % 3]
            texts |= {d: " ".join(words), d + 1: " ".join(other)}
            d += 2
    want = near_copy_groups(texts)
    assert 60 < sum(d != c for d, c in want.items()) < 120
    found = near_copies.near_copies(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == want


def test_stems_of_an_inflected_language_are_learnt(spark):
    rng = np.random.default_rng(5)
    syllables = ["ka", "mo", "ri", "tel", "su", "van", "do", "ne", "lis", "ur"]
    word = lambda: "".join(rng.choice(syllables, 3))
    rows = []
    for d in range(600):
        own = [word() for _ in range(120)]
        if d % 8 == 0:
            own[::20] = ["zorba" + word() for _ in range(6)]
        rows.append((d, " ".join(own), int(d % 8 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(docs.drop("toxic"), docs.select("doc_id", "toxic"))
    assert any("zorba".startswith(s) or s.startswith("zorba") for s in model.voters.stems)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, model).where("held_out").collect()}
    assert got == {d: toxic for d, _, toxic in rows if d in got}
