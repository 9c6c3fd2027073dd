"""Toxicity by a weighted finite-state pattern grammar.

A lexicon maps words to classes: insult, threat, target, copula, modal, negation, report, quotation mark. Five
weighted transducers are composed over a clause's classes: negation and reported speech pass the classes on with a
factor, target marks insults that come after a target, and insult and threat are the patterns. A pattern's evidence
counts only on a path that is accepted at the clause's end; the best accepted path weighs the clause. The insults
and their weights, and the map from a document's clause weights to a probability, are learned from labels.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeworks.llm.common import written
from gaugeworks.llm.ngram_join import shingles

#: Seed words by class; learned insults are added to them.
SEEDS = {
    "insult": "idiot moron stupid dumb imbecile loser scum pathetic worthless disgusting trash clown idiota estúpido imbécil basura idiote stupide connard abruti dummkopf blödmann abschaum",
    "threat": "kill hurt destroy beat punch stab shoot matar tuer töten umbringen",
    "target": "you your yours u he she they him her them his their tú tu usted te vous toi ihr du dich euch sie",
    "copula": "is are am re was were be es eres son est êtes ist bist seid sind",
    "modal": "will shall would should must going gonna want ll voy vas vais va veux werde wirst muss",
    "negation": "not no never isn aren wasn don doesn didn without nunca jamás pas jamais nicht kein keine nie",
    "report": "said says say called calls wrote writes told claimed quoted according dijo dice llamó dit disait sagte sagt nannte",
}
SEED_WEIGHT = 0.5
#: "aimed" is an insult after a target; only the target transducer puts it out.
CLASSES = ("other", "insult", "threat", "target", "copula", "modal", "negation", "report", "quote", "aimed")
OTHER, INSULT, THREAT, TARGET, COPULA, MODAL, NEGATION, REPORT, QUOTE, AIMED = range(len(CLASSES))
WEIGHTY = (INSULT, THREAT, AIMED)

CLAUSE = re.compile(r"[.!?;\n]+")
TOKEN = re.compile(r"[^\W\d_]+|[\"“”«»]")
PREFIXES = (4, 5, 6)
#: Labelled documents with this share, in hundredths, of their 5-word shingles in common are copies of one another. It is
#: read off their least SKETCH hashes: exactly where both together have no more, else with a standard error of 2.2 hundredths.
COPY_WORDS, COPY_PERCENT, SKETCH = 5, 55, 512


# -- transducers -------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Arc:
    """Where a class leads, the class it is passed on as, and the factor of a weighty word's weight.

    `evidence` is the factor of the weight that a path gains here; 0 for none.
    """

    state: int
    out: int
    factor: float = 1.0
    evidence: float = 0.0


@dataclass(frozen=True)
class Transducer:
    """A weighted transducer over classes. State 0 starts; without an arc a class stays, and is passed on as it is."""

    n_states: int
    arcs: dict[tuple[int, int], tuple[Arc, ...]] = field(default_factory=dict)
    finals: frozenset[int] | None = None

    def step(self, state: int, symbol: int) -> tuple[Arc, ...]:
        return self.arcs.get((state, symbol)) or (Arc(state, symbol),)

    def accepts(self, state: int) -> bool:
        return self.finals is None or state in self.finals


def compose(first: Transducer, second: Transducer) -> Transducer:
    """`second` reads what `first` puts out. Factors multiply; evidence of `second` is weighed by the factor of `first`."""
    arcs: dict[tuple[int, int], tuple[Arc, ...]] = {}
    for a in range(first.n_states):
        for b in range(second.n_states):
            for symbol in range(len(CLASSES)):
                arcs[a * second.n_states + b, symbol] = tuple(
                    Arc(x.state * second.n_states + y.state, y.out, x.factor * y.factor, x.evidence + x.factor * y.evidence) for x in first.step(a, symbol) for y in second.step(b, x.out)
                )
    finals = frozenset(a * second.n_states + b for a in range(first.n_states) for b in range(second.n_states) if first.accepts(a) and second.accepts(b))
    return Transducer(first.n_states * second.n_states, arcs, finals)


def negation(reach: int = 3, factor: float = 0.3) -> Transducer:
    """A negation weakens what follows within `reach` tokens."""
    arcs = {(s, NEGATION): (Arc(reach, NEGATION),) for s in range(reach + 1)}
    for s in range(1, reach + 1):
        arcs |= {(s, c): (Arc(s - 1, c, factor if c in WEIGHTY else 1.0),) for c in range(len(CLASSES)) if c != NEGATION}
    return Transducer(reach + 1, arcs)


def reported(factor: float = 0.6) -> Transducer:
    """What follows a verb of saying in its clause, or stands between quotation marks, is another's speech."""
    plain, told, quoted = 0, 1, 2
    arcs = {(plain, REPORT): (Arc(told, REPORT),), (plain, QUOTE): (Arc(quoted, QUOTE),), (told, QUOTE): (Arc(quoted, QUOTE),), (quoted, QUOTE): (Arc(plain, QUOTE),)}
    arcs |= {(s, c): (Arc(s, c, factor),) for s in (told, quoted) for c in WEIGHTY}
    return Transducer(3, arcs)


def target() -> Transducer:
    """After a target in the clause an insult is passed on as an aimed one."""
    return Transducer(2, {(0, TARGET): (Arc(1, TARGET),), (1, INSULT): (Arc(1, AIMED),)})


def insult(reach: int = 3, epithet: float = 1.0, aimed: float = 1.3, direct: float = 1.6) -> Transducer:
    """Epithet: an insult as a word of the clause. Aimed: after a target in it. Direct: right after a target ("you fiend"),
    or after target and copula with up to `reach` tokens between ("you are such a fiend")."""
    free, addressed = 0, 1
    said = lambda k: 2 + k  # tokens still allowed after the copula
    arcs: dict[tuple[int, int], tuple[Arc, ...]] = {}
    for s in range(reach + 3):
        arcs |= {(s, c): (Arc(said(s - 3) if s > 2 else free, c),) for c in range(len(CLASSES))}
        arcs |= {(s, TARGET): (Arc(addressed, TARGET),), (s, INSULT): (Arc(free, INSULT, evidence=epithet),)}
        arcs |= {(s, AIMED): (Arc(free, AIMED, evidence=direct if s != free else aimed),)}
    arcs[addressed, COPULA] = (Arc(said(reach), COPULA),)
    return Transducer(reach + 3, arcs)


def threat(reach: int = 4, plain: float = 1.0, meant: float = 1.5) -> Transducer:
    """A verb of violence and then a target within `reach` tokens; or modal, target and such a verb, each within `reach`.

    A path that has taken the verb is accepted only when the target has come. With a modal before, it is meant.
    """
    n = reach + 1
    free, modal, both, open_ = 0, 1, 1 + n, 1 + 2 * n  # with 0 to reach tokens left

    def wait(base: int, left: int, c: int) -> Arc:
        return Arc(base + left - 1 if left else free, c)

    arcs: dict[tuple[int, int], tuple[Arc, ...]] = {(free, THREAT): (Arc(free, THREAT), Arc(open_ + reach, THREAT, evidence=plain)), (free, MODAL): (Arc(modal + reach, MODAL),)}
    for k in range(n):
        for c in range(len(CLASSES)):
            arcs[modal + k, c] = (wait(modal, k, c),)
            arcs[both + k, c] = (wait(both, k, c),)
            # a verb whose target doesn't come in time leads nowhere
            arcs[open_ + k, c] = (Arc(open_ + k - 1, c),) if k else (Arc(1 + 3 * n, c),)
        arcs[modal + k, TARGET] = (Arc(both + reach, TARGET),)
        arcs[modal + k, THREAT] = (Arc(free, THREAT), Arc(open_ + reach, THREAT, evidence=meant))
        arcs[both + k, THREAT] = (Arc(free, THREAT, evidence=meant),)
        arcs[modal + k, MODAL] = arcs[both + k, MODAL] = (Arc(modal + reach, MODAL),)
        arcs[open_ + k, TARGET] = (Arc(free, TARGET),)
    return Transducer(2 + 3 * n, arcs, frozenset(range(open_)))


#: In the order in which they read the clause.
PARTS = (negation(), reported(), target(), insult(), threat())
GRAMMAR = reduce(compose, PARTS)


# -- the model ---------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Settings:
    """The training sample is at most `max_docs` labelled documents, those with the smallest hashes of their ids."""

    max_docs: int = 10_000
    max_patterns: int = 300
    min_docs: int = 4
    min_share: float = 0.005
    min_precision: float = 0.95
    doubt: float = 8.0
    buckets: int = 12


@dataclass(frozen=True)
class Model:
    """`words` and `stems` (word beginnings) with their insult weights; points of the calibration curve."""

    words: dict[str, float]
    stems: dict[str, float]
    curve: tuple[tuple[float, float], ...] = ((0.0, 0.0), (1.0, 1.0))

    def score(self, total: float) -> float:
        points = self.curve
        if total <= points[0][0]:
            return points[0][1]
        for (x0, y0), (x1, y1) in zip(points, points[1:]):
            if total <= x1:
                return y0 + (y1 - y0) * (total - x0) / (x1 - x0)
        return points[-1][1]


class Scorer:
    """Clause weights of texts under a model and the grammar."""

    def __init__(self, model: Model, grammar: Transducer = GRAMMAR):
        import ahocorasick

        self._grammar = grammar
        self._classes = {w: CLASSES.index(name) for name, words in SEEDS.items() for w in words.split()} | dict.fromkeys('"“”«»', QUOTE)
        self._words, self._stems = model.words, model.stems
        self._lengths = sorted({len(s) for s in model.stems})
        self._any = ahocorasick.Automaton()
        for pattern in [*model.words, *model.stems, *SEEDS["insult"].split(), *SEEDS["threat"].split()]:
            self._any.add_word(pattern, True)
        self._any.make_automaton()

    def symbol(self, token: str) -> tuple[int, float]:
        """A token's class and weight."""
        symbol = self._classes.get(token, OTHER)
        weight = SEED_WEIGHT if symbol in (INSULT, THREAT) else 0.0
        learned = max(self._words.get(token, 0.0), *(self._stems.get(token[:n], 0.0) for n in self._lengths), 0.0)
        return (INSULT, max(learned, weight)) if learned else (symbol, weight)

    def clause(self, clause: str) -> float:
        """1 - exp(-the evidence of the best accepted path); a word's evidence is -log(1 - weight times factor)."""
        symbols = [self.symbol(token) for token in TOKEN.findall(clause)]
        if not any(s in WEIGHTY for s, _ in symbols):
            return 0.0
        paths = {0: 0.0}
        for symbol, weight in symbols:
            ahead: dict[int, float] = {}
            for state, gained in paths.items():
                for arc in self._grammar.step(state, symbol):
                    total = gained - math.log1p(-min(0.99, weight * arc.evidence))
                    if total > ahead.get(arc.state, -1.0):
                        ahead[arc.state] = total
            paths = ahead
        return -math.expm1(-max((g for s, g in paths.items() if self._grammar.accepts(s)), default=0.0))

    def total(self, text: str | None) -> tuple[float, int, float]:
        """The sum over matched clauses, their number and the worst; all 0 for a null, empty or clean text."""
        low = (text or "").lower()
        if next(self._any.iter(low), None) is None:
            return 0.0, 0, 0.0
        found = [w for w in map(self.clause, CLAUSE.split(low)) if w > 0]
        return math.fsum(found), len(found), max(found, default=0.0)


def _beginnings(n: int) -> Column:
    """The first n letters of each longer word, with an asterisk."""
    return F.transform(F.filter("words", lambda w: F.char_length(w) > n), lambda w: F.concat(F.substring(w, 1, n), F.lit("*")))


def link_copies(sketches: list[np.ndarray], percent: int = COPY_PERCENT, size: int = SKETCH) -> np.ndarray:
    """For each sketch (sorted distinct hashes, at most `size`) the number of its group: what links of copies reach.

    Two are copies if of the least `size` hashes of their union at least `percent` in a hundred are in both. Then they
    share as large a part of either sketch, so they meet in the rarest hashes of each; only those that do and aren't
    in one group already are compared. An empty sketch is a group of its own.
    """
    group = np.arange(len(sketches))
    held: dict[bytes, int] = {}
    for i, s in enumerate(sketches):
        group[i] = held.setdefault(s.tobytes(), i) if len(s) else i
    members = [i for i in held.values()]
    if not members:
        return group
    flat, lengths = np.concatenate([sketches[i] for i in members]), np.array([len(sketches[i]) for i in members])
    owner = np.repeat(np.arange(len(members)), lengths)
    _, token, often = np.unique(flat, return_inverse=True, return_counts=True)
    order = np.lexsort((token, often[token], owner))
    place = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    rare = order[(place < (lengths - (lengths * percent + 99) // 100 + 1)[owner]) & (often[token[order]] > 1)]
    token, owner = token[rare], owner[rare]  # by owner still
    begins = np.searchsorted(owner, np.arange(len(members) + 1))
    by_token = np.argsort(token, kind="stable")
    holders, starts = owner[by_token], np.searchsorted(token[by_token], np.arange(len(often) + 1))
    found = np.arange(len(members))
    for i in range(1, len(members)):
        met = np.zeros(len(members), bool)
        for t in token[begins[i] : begins[i + 1]]:
            met[holders[starts[t] : starts[t + 1]]] = True
        others = np.flatnonzero(met[:i])
        while len(others := others[found[others] != found[i]]):
            a, b = sketches[members[i]], sketches[members[others[0]]]
            least, n = np.unique(np.concatenate([a, b]), return_counts=True)
            if 100 * np.count_nonzero(n[:size] == 2) >= percent * len(least[:size]):
                found[found == found[i]] = found[others[0]]
            others = others[1:]
    number = np.arange(len(sketches))
    number[members] = np.array(members)[found]
    return number[group]


def _copy_groups(rows: DataFrame) -> DataFrame:
    """row, group: whole texts are cut into shingles where they are; the sketches, at most max_docs times 4 KB, go to one task."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"row": batch["row"], "sketch": [shingles(t, COPY_WORDS)[:SKETCH].tobytes() for t in batch["text"]]})

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if parts:
            both = pd.concat(parts).sort_values("row")
            yield pd.DataFrame({"row": both["row"], "group": link_copies([np.frombuffer(b, np.uint64) for b in both["sketch"]])})

    return rows.select("row", "text").mapInPandas(cut, "row long, sketch binary").repartition(1).mapInPandas(link, "row long, group long")


def _patterns(sample: DataFrame, settings: Settings) -> tuple[dict[str, float], dict[str, float]]:
    """Words and word beginnings that toxic documents hold and others hardly ever do, with their weights. `sample` has id, toxic, text, row.

    Of a group of near copies (from an n-gram Jaccard of 0.55 on, chains included) only one counts:
    else the words of one toxic document with many copies would pass for insults. It is a toxic one if the group
    has any, with the smallest id among those. Different documents count each, however many words they share.
    """
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1)))
    stems = [_beginnings(n) for n in PREFIXES]
    long = F.filter("words", lambda w: F.char_length(w) >= PREFIXES[0])
    one = F.min_by(F.struct("toxic", words.alias("words")), F.struct(-F.col("toxic"), "id", "row"))
    groups = F.broadcast(_copy_groups(sample))  # a row per sampled document
    sample = written(sample.join(groups, "row").groupBy("group").agg(one.alias("d")).select("d.*"), "toxicity-sample")
    features = sample.select("toxic", F.explode(F.array_distinct(F.concat(long, *stems))).alias("pattern"))
    sizes = sample.agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")).first()
    bad, good = sizes["bad"] or 0, sizes["good"] or 0
    least = max(settings.min_docs, math.ceil(settings.min_share * bad))
    counted = features.groupBy("pattern").agg(F.sum("toxic").alias("bad"), F.count("*").alias("n")).where(F.col("bad") >= least)
    chosen = counted.where(F.col("bad") >= F.col("n") * settings.min_precision).orderBy(F.desc("bad"), F.length("pattern").desc(), "pattern").limit(settings.max_patterns * 10)
    found: tuple[dict[str, float], dict[str, float]] = {}, {}
    support: dict[str, int] = {}
    for row in chosen.collect():  # bounded by the limit
        pattern, n = row["pattern"], row["bad"]
        stem = pattern.removesuffix("*")
        implied = any(stem.startswith(s) for s in found[1])
        same = pattern != stem and any(w.startswith(stem) and k >= 0.9 * n for w, k in support.items())
        if implied or same or len(support) >= settings.max_patterns:
            continue
        rate, base = (n + 0.5) / (bad + 1), (row["n"] - n + 0.5) / (good + 1)
        # patterns of few documents may come from copies of one, so they weigh less
        found[pattern != stem][stem] = 0.95 * rate / (rate + base) * n / (n + settings.doubt)
        support[stem] = n
    return found


def _isotonic(points: list[tuple[float, int, int]]) -> tuple[tuple[float, float], ...]:
    """Smoothed rates by clause weight, pooled so that they never fall. points: weight, toxic, all; by weight."""
    pools: list[list[float]] = []
    for x, bad, n in points:
        pools.append([x, x, bad, n])
        while len(pools) > 1 and pools[-2][2] * pools[-1][3] >= pools[-1][2] * pools[-2][3]:
            _, x1, b1, n1 = pools.pop()
            pools[-1][1:] = [x1, pools[-1][2] + b1, pools[-1][3] + n1]
    curve = []
    for x0, x1, bad, n in pools:
        rate = (bad + 0.5) / (n + 1)
        curve += [(x0, rate)] + [(x1, rate)] * (x1 > x0)
    return tuple(curve)


TOTAL_SCHEMA = "id long, total double, clauses int, worst double"


def clause_totals(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, total (the sum of clause weights), clauses (how many matched), worst; a row per input row, no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(model)
        for batch in batches:
            out = pd.DataFrame([scorer.total(text) for text in batch["text"]], columns=["total", "clauses", "worst"])
            out.insert(0, "id", batch["id"].to_numpy())
            yield out

    return docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")).mapInPandas(run, TOTAL_SCHEMA)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> Model:
    """Learn from the labelled documents: `labels` has the id and `toxic` (0 or 1; null rows are left out).

    Only a bounded sample of ids is broadcast, see Settings. Patterns come from three quarters of the sample and
    the curve from the fourth. With no labels the seeds are all there is, and a clause of weight 1 scores 0.5.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col("toxic").cast("int").alias("toxic"))
    ids = known.groupBy("id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(settings.max_docs)
    sample = docs.select(docs[id_col].alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text")).join(F.broadcast(ids), "id")
    quarter = F.pmod(F.xxhash64(F.lit("quarter"), "id"), F.lit(4))
    # written, so that all texts are read once; ids may repeat with other texts, so rows are numbered
    sample = written(sample.withColumns({"quarter": quarter, "row": F.monotonically_increasing_id()}), "toxicity-rows")
    words, stems = _patterns(sample.where("quarter > 0"), settings)
    model = Model(words, stems)
    step = 0.25
    totals = clause_totals(sample.where("quarter = 0"), model, "id")
    bucket = F.least(F.ceil(F.col("total") / step), F.lit(settings.buckets)).alias("bucket")
    rows = totals.join(F.broadcast(ids), "id").groupBy(bucket).agg(F.sum("toxic").alias("bad"), F.count("*").alias("n")).collect()  # a row per bucket
    points = sorted((r["bucket"] * step, r["bad"], r["n"]) for r in rows)
    return Model(words, stems, _isotonic(points) if any(x > 0 for x, _, _ in points) and any(b for _, b, _ in points) else ((0.0, 0.02), (1.0, 0.5), (3.0, 0.9)))


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score (0 to 1), predicted (score >= 0.5), clauses, worst; a row per input row.

    Null, empty and clean texts get the rate of toxic labels among sampled texts without a match.
    """
    xs, ys = [x for x, _ in model.curve], [y for _, y in model.curve]
    total = F.col("total")
    score = F.lit(ys[-1])
    for i in reversed(range(1, len(xs))):
        line = F.lit(ys[i - 1]) + (total - xs[i - 1]) * ((ys[i] - ys[i - 1]) / (xs[i] - xs[i - 1]) if xs[i] > xs[i - 1] else 0.0)
        score = F.when(total <= xs[i], line).otherwise(score)
    score = F.when(total <= xs[0], F.lit(ys[0])).otherwise(score)
    return clause_totals(docs, model, id_col, text_col).select("id", score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), "clauses", "worst")


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text", reject_at: float = 0.5) -> DataFrame:
    """The rows of `docs`, all columns as they are, whose score is below `reject_at`. Null and empty texts stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            yield batch.filter(pa.array([model.score(scorer.total(t)[0]) < reject_at for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
