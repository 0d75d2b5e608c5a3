"""Toxicity by weak supervision.

Voters (word lists, word beginnings and patterns, some learnt from labelled texts) vote on every document or abstain. A
generative label model is fitted to how often each set of votes occurs over the whole corpus: it estimates each voter's
rate of firing on toxic and other documents by expectation maximisation, and the correlations that this leaves between
voters, by which correlated voters count less. Its posteriors label a bounded sample, on which a linear classifier over
word counts and patterns is trained; the classifier scores every document.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import map_rows
from .tokens import Memo, alone

# General English lists for the lexicon voters.
LEXICON = {
    "insult": "idiot idiots moron morons stupid dumb loser losers imbecile cretin dimwit halfwit jerk clown clowns buffoon".split(),
    "contempt": "pathetic worthless useless disgusting trash garbage scum filth filthy vermin lowlife".split(),
    "threat": "kill murder strangle destroy punish exterminate".split(),
    "slight": "ugly creep freak weirdo hate hated despise nobody shut sucks".split(),
}
# The pattern voters.
PATTERNS = {
    "address": r"(?i)\byou(?:'re| are)? (?:an?|such an?|so|all) \w+",
    "shouting": r"\b[A-Z]{4,}(?:\W+[A-Z]{4,}){2}",
    "exclaim": r"[!?]{3,}",
}
#: Labelled rows that are learnt from at most, words learnt at most, voters that share them, and the classifier's ridge.
MOST_LABELLED, LEARNT_WORDS, LEARNT_VOTERS, RIDGE = 20_000, 40, 4, 1.0
#: Rows of a batch that are filtered at once.
KEEP_ROWS = 1024
#: Lengths of word beginnings (stems, for languages that inflect and compound), stems learnt at most, and from which count and share of a text's words on they vote.
STEM_SIZES, LEARNT_STEMS, STEM_COUNT, STEM_SHARE = (4, 5, 6), 40, 2, 0.01
THRESHOLD = 0.3
#: Say of the labelled votes in the label model, as a share of the corpus's: one voter alone could not be told otherwise.
HOLD = 0.2
_TRIM = "".join(chr(c) for c in range(33, 128) if not chr(c).isalnum()) + "«»“”‘’„…–—¿¡"


def held_out(doc_id: Column) -> Column:
    """True for rows that no label is learnt from: crc32 of the id as text, modulo 4, is 2."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def words_of(text: str | None) -> list[str]:
    return [w for c in (text or "").lower().split() if (w := c.strip(_TRIM))]


@dataclass(frozen=True)
class Voters:
    """Word lists by voter name, the stems (one voter) and the patterns; voters number 12 at most, so sets of votes number 4096 at most."""

    lists: dict[str, list[str]]
    patterns: dict[str, str] = field(default_factory=lambda: dict(PATTERNS))
    stems: list[str] = field(default_factory=list)

    @property
    def names(self) -> list[str]:
        return [*self.lists, "stems", *self.patterns]

    @property
    def words(self) -> list[str]:
        return sorted({w for words in self.lists.values() for w in words})

    def reader(self):
        """A function from a text to (word counts, stem counts, pattern flags, number of words)."""
        index = {w: k + 1 for k, w in enumerate(self.words)}
        stems = {stem: len(index) + k + 1 for k, stem in enumerate(self.stems)}
        width = len(index) + len(stems)

        def known(chunk: str) -> int:
            word = chunk.lower().strip(_TRIM)
            return index.get(word) or next((stems[word[:n]] for n in STEM_SIZES if len(word) > n and word[:n] in stems), 0)

        alone()
        memo = Memo(known, 150_000)
        patterns = [re.compile(p) for p in self.patterns.values()]

        def read(text: str | None) -> tuple[np.ndarray, np.ndarray, list[bool], int]:
            chunks = (text or "").split()
            found = [k for k in map(memo.__getitem__, chunks) if k]
            counts = np.bincount(found, minlength=width + 1)[1:] if found else np.zeros(width, np.int64)
            return counts[: len(index)], counts[len(index) :], [bool(p.search(text or "")) for p in patterns], len(chunks)

        return read

    def member(self) -> np.ndarray:
        """Voters by words: 1 where the voter's list has the word."""
        at = {w: k for k, w in enumerate(self.words)}
        out = np.zeros((len(self.lists), len(at)), bool)
        for v, words in enumerate(self.lists.values()):
            out[v, [at[w] for w in words]] = True
        return out


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, most: int = MOST_LABELLED) -> DataFrame:
    """(text, toxic) of up to ``most`` labelled rows that are not held out, chosen by a hash of the id. Null labels are left out."""
    chosen = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("label_id"), "toxic")
    chosen = chosen.orderBy(F.xxhash64("label_id"), "label_id", "toxic").limit(most)
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).select("text", "toxic")


def learnt_words(sample: DataFrame, most: int = LEARNT_WORDS, most_stems: int = LEARNT_STEMS) -> tuple[list[str], list[str]]:
    """Words far more frequent in toxic sample texts than in others, best first, and stems that repeat in them and hardly in others.

    A text speaks for a stem whose words number two or more and half of ``STEM_SHARE`` of all. Stems of listed words are left out.
    """

    def count(rows: Iterator[tuple]) -> Iterator[tuple]:
        seen = (Counter(), Counter())
        for text, toxic in rows:
            kind, words = seen[toxic > 0], words_of(text)
            kind.update(set(words))
            kind[""] += 1
            # A star marks a stem; words end with none.
            stems = Counter(w[:n] + "*" for w in words for n in STEM_SIZES if len(w) > n)
            kind.update(k for k, n in stems.items() if n >= STEM_COUNT and n >= STEM_SHARE / 2 * len(words))
        for word in seen[0].keys() | seen[1].keys():
            yield word, seen[1][word], seen[0][word]

    schema = pa.schema([("word", pa.string()), ("toxic", pa.int64()), ("other", pa.int64())])
    sums = map_rows(sample, count, "word string, toxic long, other long", schema).groupBy("word").agg(F.sum("toxic").alias("t"), F.sum("other").alias("o")).cache()
    total = sums.where("word = ''").first()
    if not total or not total["t"] or not total["o"]:
        sums.unpersist()
        return [], []
    nt, no = total["t"], total["o"]
    odds = F.log((F.col("t") + 0.5) / (nt + 1)) - F.log((F.col("o") + 0.5) / (no + 1))
    sure = (F.col("t") - F.sqrt("t")) / nt > 10 * (F.col("o") + 1) / no
    best = sums.where(sure).select("word", "t", (odds * F.col("t")).alias("gain")).orderBy(F.desc("gain"), "word")
    is_stem = F.col("word").endswith("*")
    words = [r["word"] for r in best.where(~is_stem & (F.col("word") != "") & (F.col("t") >= max(5, 0.08 * nt))).limit(most).collect()]
    listed, stems = {*words, *(w for own in LEXICON.values() for w in own)}, []
    for r in best.where(is_stem & (F.col("t") >= max(8, 0.02 * nt))).limit(most_stems + len(STEM_SIZES) * len(listed)).collect():
        stem = r["word"][:-1]
        if len(stems) < most_stems and not any(w.startswith(stem) for w in listed) and not any(x.startswith(stem) or stem.startswith(x) for x in stems):
            stems.append(stem)
    sums.unpersist()
    return words, stems


def make_voters(words: list[str], stems: list[str]) -> Voters:
    learnt = {f"learnt{k}": own for k in range(LEARNT_VOTERS) if (own := words[k::LEARNT_VOTERS])}
    return Voters({**LEXICON, **learnt}, stems=stems)


def dense(stems: np.ndarray, n: int) -> bool:
    """Whether the stems' words are many enough in a text of ``n`` words for a vote."""
    return bool(stems.sum() >= STEM_COUNT and stems.sum() >= STEM_SHARE * n)


def vote_counts(docs: DataFrame, voters: Voters, text_col: str = "text") -> dict[int, int]:
    """How many documents cast each set of votes (bit k: voter k), over all documents."""
    member = voters.member()

    def count(rows: Iterator[tuple]) -> Iterator[tuple]:
        read, seen = voters.reader(), Counter()
        for (text,) in rows:
            counts, stems, flags, n = read(text)
            fired = [*(member @ counts > 0), dense(stems, n), *flags]
            seen[sum(1 << k for k, x in enumerate(fired) if x)] += 1
        yield from seen.items()

    schema = pa.schema([("votes", pa.int64()), ("n", pa.int64())])
    counted = map_rows(docs.select(docs[text_col]), count, "votes long, n long", schema)
    return {r[0]: r[1] for r in counted.groupBy("votes").agg(F.sum("n")).collect()}  # 4096 rows at most


@dataclass(frozen=True)
class LabelModel:
    """Share of toxic documents, rates of firing (voters by class 0, 1), rates of no vote at all, correlations left, and the weight each voter keeps."""

    prior: float
    rates: np.ndarray
    quiet: np.ndarray
    correlations: np.ndarray
    weights: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of toxic for rows of 0/1 votes. A voter that abstains says nothing; that all abstain is evidence of its own."""
        fired = votes @ (self.weights * (np.log(self.rates[:, 1]) - np.log(self.rates[:, 0])))
        none = (votes.sum(1) == 0) * (np.log(self.quiet[1]) - np.log(self.quiet[0]))
        return 1 / (1 + np.exp(-(np.log(self.prior / (1 - self.prior)) + fired + none)))


def first_guess(votes: np.ndarray, toxic: np.ndarray) -> LabelModel:
    """The label model as the labelled votes alone show it, from which the estimation over all documents starts."""
    yes, no = votes[toxic > 0], votes[toxic <= 0]
    share = lambda x, n: (x + 0.5) / (n + 1)
    rates = np.column_stack([share(own.sum(0), len(own)) for own in (no, yes)])
    quiet = np.asarray([share((own.sum(1) == 0).sum(), len(own)) for own in (no, yes)])
    n = votes.shape[1]
    return LabelModel(float(np.clip(share(len(yes), len(votes)), 1e-4, 0.5)), rates, quiet, np.eye(n), np.ones(n))


def fit_label_model(counts: dict[int, int], voters: int, rounds: int = 3, steps: int = 60, start: LabelModel | None = None, hold: float = 0.0) -> LabelModel:
    """Expectation maximisation over the counts of vote sets from ``start`` (default: rare voters that lean to toxic), which weighs like ten documents and a share ``hold`` of all; after each round, voters that stay positively correlated within the classes count less."""
    sets = np.asarray(sorted(counts), np.int64)
    votes = (sets[:, None] >> np.arange(voters) & 1).astype(float)
    n = np.asarray([counts[int(s)] for s in sets], float)
    start = start or LabelModel(0.1, np.tile([0.02, 0.3], (voters, 1)), np.asarray([0.9, 0.1]), np.eye(voters), np.ones(voters))
    if not n.sum():
        return start
    model = start
    for _ in range(rounds):
        model = LabelModel(start.prior, start.rates, start.quiet, model.correlations, model.weights)
        for _ in range(steps):
            p = model.posterior(votes)
            mass = np.stack([n * (1 - p), n * p])
            # A weak prior keeps rates inside (0, 1), and a toxic document the likelier one to make a voter fire.
            ghosts = 10 + hold * mass.sum(1)
            rates = ((mass @ votes + ghosts[:, None] * start.rates.T) / (mass.sum(1) + ghosts)[:, None]).T
            rates[:, 1] = np.maximum(rates[:, 1], rates[:, 0])
            quiet = (mass @ (votes.sum(1) == 0) + ghosts * start.quiet) / (mass.sum(1) + ghosts)
            model = LabelModel(float(np.clip((mass[1].sum() / n.sum() + hold * start.prior) / (1 + hold), 1e-4, 0.5)), rates, quiet, model.correlations, model.weights)
        p = model.posterior(votes)
        left = np.zeros((voters, voters))
        for k, m in enumerate((n * (1 - p), n * p)):
            rest = votes - model.rates[:, k]
            left += (m[:, None] * rest).T @ rest
        scale = np.sqrt(np.maximum(np.diag(left), 1e-9))
        correlations = left / np.outer(scale, scale)
        model = LabelModel(model.prior, model.rates, model.quiet, correlations, 1 / (1 + np.maximum(correlations - np.eye(voters) - 0.1, 0).sum(1)))
    return model


@dataclass(frozen=True)
class ToxicityModel:
    voters: Voters
    weights: np.ndarray
    bias: float


def features(counts: np.ndarray, stems: np.ndarray, flags: list[bool], n: int) -> np.ndarray:
    """Logarithm of each word's count; whether there is any, the logarithm of all, their share; the stems' vote, logarithm and share; and the patterns."""
    total, begun = counts.sum(), stems.sum()
    sums = [float(total > 0), np.log1p(total), min(1.0, 20 * total / max(n, 1)), float(dense(stems, n)), np.log1p(begun), min(1.0, 20 * begun / max(n, 1))]
    return np.concatenate([np.log1p(counts), sums, flags]).astype(float)


def fit_linear(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, steps: int = 25) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by Newton steps; the bias is not held down."""
    a = np.column_stack([x, np.ones(len(x))])
    held = ridge * np.eye(a.shape[1])
    held[-1, -1] = 1e-3
    w = np.zeros(a.shape[1])
    w[-1] = np.log(np.clip(y.mean(), 1e-3, 0.999) / (1 - np.clip(y.mean(), 1e-3, 0.999)))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + held, a.T @ (y - p) - held @ w)
        w += step * min(1.0, 4 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """The model of ``docs``. Without labelled rows the fixed lists alone vote and every listed word weighs the same.

    Null texts count as empty, null labels and labels without an id or a document are left out, and an id that is labelled
    or stored more than once counts as often. An empty table gives the model of the fixed lists.
    """
    sample = labelled_sample(docs, labels, id_col, text_col)
    voters = make_voters(*learnt_words(sample))
    member = voters.member()

    def read_all(rows: Iterator[tuple]) -> Iterator[tuple]:
        read = voters.reader()
        for text, toxic in rows:
            counts, stems, flags, n = read(text)
            yield features(counts, stems, flags, n).tolist(), [*(member @ counts > 0).astype(float).tolist(), float(dense(stems, n)), *map(float, flags)], float(toxic)

    schema = pa.schema([("x", pa.list_(pa.float64())), ("votes", pa.list_(pa.float64())), ("toxic", pa.float64())])
    rows = map_rows(sample, read_all, "x array<double>, votes array<double>, toxic double", schema).collect()  # MOST_LABELLED rows at most
    if not rows:
        return ToxicityModel(voters, np.concatenate([np.ones(len(voters.words) + 3), np.zeros(3 + len(voters.patterns))]), -2.5)
    rows.sort()
    x, votes, toxic = (np.asarray([r[k] for r in rows]) for k in range(3))
    heard = worth_hearing(votes, toxic)
    sets: Counter = Counter()
    for fired, n in vote_counts(docs, voters, text_col).items():
        sets[sum(1 << j for j, k in enumerate(heard) if fired >> k & 1)] += n
    model = fit_label_model(sets, len(heard), start=first_guess(votes[:, heard], toxic), hold=HOLD)
    x[:, len(voters.words) + 6 :] *= np.isin(np.arange(len(voters.patterns)) + len(voters.lists) + 1, heard)
    weights, bias = fit_linear(x, model.posterior(votes[:, heard]))
    return ToxicityModel(voters, weights, bias)


def worth_hearing(votes: np.ndarray, toxic: np.ndarray, lift: float = 2.0) -> np.ndarray:
    """Voters that fire on labelled toxic texts ``lift`` times as often as on the others, or on too few to tell."""
    yes, no = ((own.sum(0) + 0.5) / (len(own) + 1) for own in (votes[toxic > 0], votes[toxic <= 0]))
    return np.flatnonzero((yes >= lift * no) | (votes.sum(0) < 5))


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, score (0 to 1), predicted (1 from ``THRESHOLD`` on).

    A null text counts as empty and gets the score of a text without any listed word; a null id stays null and is not held
    out; repeated rows stay; an empty table gives no row. No shuffle.
    """

    def make(rows: Iterator[tuple]) -> Iterator[tuple]:
        read = model.voters.reader()
        for doc_id, out, text in rows:
            p = float(1 / (1 + np.exp(-np.clip(features(*read(text)) @ model.weights + model.bias, -30, 30))))
            yield doc_id, out, p, int(p >= THRESHOLD)

    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])
    rows = docs.select(docs[id_col].alias("doc_id"), held_out(docs[id_col]).alias("held_out"), docs[text_col].alias("text"))
    return map_rows(rows, make, "doc_id long, held_out boolean, score double, predicted int", schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without those that the model calls toxic; all columns stay. The text is scored row by row, without a join.

    Null and empty texts and rows without an id are scored and kept alike; repeated rows have one fate.
    """
    model = train(docs, labels, id_col, text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = model.voters.reader()
        limit = np.log(THRESHOLD / (1 - THRESHOLD))
        for batch in batches:
            for at in range(0, len(batch), KEEP_ROWS):
                part = batch.slice(at, KEEP_ROWS)
                texts = part.column(part.schema.get_field_index(text_col)).to_pylist()
                kept = [bool(features(*read(t)) @ model.weights + model.bias < limit) for t in texts]
                yield part.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
