"""Language-model scoring by a hierarchical Pitman-Yor process over words and the words before them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corpusloom.llm.arrow import Texts, pieces
from corpusloom.llm.buckets import whole_groups
from corpusloom.llm.restaurants import reseat, seat
from corpusloom.llm.words import SPACE, find_words, word_hashes
from corpusloom.session import materialize, release

# Contexts are told apart by 16 bits: 0 is the start of a text, then come the most
# frequent words, and the words beyond share the remaining restaurants by hash.
CONTEXTS = 1 << 16
FREQUENT = 64_512
# Tokens that a task gathers before it hands them on, and that a bucket of words holds about.
FLUSH, BUCKET = 1 << 19, 1 << 18
# A word with more tokens than this is hot: it has a bucket of its own, and its contexts are counted in parts.
HOT, PARTS = 1 << 20, 32
# Documents are numbered by 16 bits between two hand-overs.
MAX_DOCS = 1 << 16
# Documents whose sums a task holds before it hands them on.
HELD = 1 << 19
# Fixed value: stands for the end of a text among the word hashes.
END = np.uint64(0x5DEECE66D1CE4E5B)
SEED = 13
# Number types of the arrays that a row holds as bytes: a bucket is one row of few large values.
KINDS = {
    "words": "<u8", "sizes": "<i4", "ctx": "<u2", "n": "<i4", "t": "<i4", "t_sum": "<i4", "root_t": "<i4", "roots": "<f4",
    "doc": "<u2", "n_tokens": "<i4", "sums": "<f8",
}
# Fixed values of the base score: what is added to counts.
ADDED = 0.1


@dataclass(frozen=True)
class Prior:
    """Discounts and strengths of the context restaurants and of their parent, and the sampling schedule."""

    discount: float = 0.75
    strength: float = 2.0
    root_discount: float = 0.7
    root_strength: float = 10.0
    burn_in: int = 2
    samples: int = 3
    moves: int = 8


def held_out(doc_id: Column) -> Column:
    """Documents that take no part in learning. A null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 10 == 0, F.lit(False))


class Tokens:
    """Tokens of some texts: words in lower-case A-Z, and an end after each text."""

    def __init__(self, texts: Texts):
        data = texts.data
        small = Texts(np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8), texts.bounds, texts.first)
        words = find_words(small, SPACE)
        ends = words.bounds[1:] + np.arange(len(texts))
        self.counts = words.counts + 1
        self.values = np.empty(len(words.starts) + len(texts), np.uint64)
        inner = np.ones(len(self.values), bool)
        inner[ends] = False
        self.values[ends] = END
        self.values[inner] = word_hashes(small, words, SEED)
        # The place of each text's first token, which has the start as its context.
        self.starts = ends - words.counts


def count_words(docs: DataFrame) -> DataFrame:
    """``(word, n)`` over all tokens of ``docs``; a task adds up its own words first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for texts in pieces(batch.column(0)):
                values = Tokens(texts).values
                held.append(values)
                size += len(values)
                if size >= 4 * FLUSH:
                    yield counted(held)
                    held, size = [], 0
        if held:
            yield counted(held)

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        words, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], names=["word", "n"])

    return docs.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def shared_context(word: Column) -> Column:
    """The context that words beyond the frequent ones share."""
    return (F.shiftrightunsigned(word, 40) % (CONTEXTS - 1 - FREQUENT) + FREQUENT + 1).cast("int")


@dataclass(frozen=True)
class Vocabulary:
    """What tasks know of all words: totals, frequent words, and hot ones. Its size is bounded.

    ``frequent`` is sorted, ``codes`` are the contexts of these words, ``after``
    counts the training tokens in each context. There are at most ``tokens / HOT``
    hot words.
    """

    tokens: int
    types: int
    frequent: np.ndarray
    codes: np.ndarray
    after: np.ndarray
    hot: np.ndarray
    hot_counts: np.ndarray
    buckets: int

    @classmethod
    def of(cls, words: DataFrame) -> "Vocabulary":
        total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
        end = int(END.view(np.int64))
        # At most FREQUENT rows.
        top = words.where(F.col("word") != end).orderBy(F.desc("n"), "word").limit(FREQUENT).toArrow()
        ranked, n = top.column("word").to_numpy().view(np.uint64), top.column("n").to_numpy()
        order = np.argsort(ranked)
        after = np.zeros(CONTEXTS, np.int64)
        after[1 : len(n) + 1] = n
        starts = words.where(F.col("word") == end).first()
        after[0] = starts["n"] if starts else 0
        if len(n) == FREQUENT:
            least, last = int(n[-1]), int(ranked[-1].view(np.int64))
            rarer = (F.col("n") < least) | ((F.col("n") == least) & (F.col("word") > last))
            rest = words.where(rarer & (F.col("word") != end)).groupBy(shared_context(F.col("word")).alias("code")).agg(F.sum("n").alias("n"))
            for row in rest.collect():  # one row per shared context
                after[row["code"]] = row["n"]
        # At most one word per HOT tokens.
        hot = words.where(F.col("n") > HOT).orderBy("word").toArrow()
        hot_words = hot.column("word").to_numpy().view(np.uint64)
        place = np.argsort(hot_words)
        return cls(
            int(total["n"]), int(total["v"]), ranked[order], (order + 1).astype(np.int32), after,
            hot_words[place], hot.column("n").to_numpy()[place], int(total["n"]) // BUCKET + 1,
        )

    def contexts(self, words: np.ndarray) -> np.ndarray:
        """The context that each word is for the token after it."""
        out = ((words >> np.uint64(40)) % np.uint64(CONTEXTS - 1 - FREQUENT)).astype(np.int32) + FREQUENT + 1
        at = np.minimum(np.searchsorted(self.frequent, words), max(len(self.frequent) - 1, 0))
        if len(self.frequent):
            known = self.frequent[at] == words
            out[known] = self.codes[at[known]]
        return out

    def places(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bucket of each word, rising with the word, and its number among the hot words or -1, which have buckets of their own."""
        hot = np.full(len(words), -1)
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, words), len(self.hot) - 1)
            hot = np.where(self.hot[at] == words, at, -1)
        bucket = ((words >> np.uint64(32)) * np.uint64(self.buckets) >> np.uint64(32)).astype(np.int64)
        return np.where(hot >= 0, self.buckets + hot, bucket), hot


class Flush:
    """Tokens of several texts with their words ranked and their contexts looked up."""

    def __init__(self, held: list[Tokens], vocabulary: Vocabulary):
        values = np.concatenate([t.values for t in held])
        counts = np.concatenate([t.counts for t in held])
        self.words, self.rank = np.unique(values, return_inverse=True)
        self.context = np.zeros(len(values), np.int64)
        self.context[1:] = vocabulary.contexts(self.words)[self.rank[:-1]]
        self.context[np.cumsum(counts) - counts] = 0
        self.doc = np.repeat(np.arange(len(counts)), counts)
        self.bucket, self.hot = vocabulary.places(self.words)


def pack(name: str, values: np.ndarray, bounds: np.ndarray) -> pa.BinaryArray:
    """Runs of an array, each as the bytes of one row."""
    data = np.ascontiguousarray(values, KINDS[name])
    offsets = (bounds * data.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def unpack(rows: pa.RecordBatch | pa.Table, i: int, *names: str) -> list[np.ndarray]:
    """The arrays of row ``i``."""
    return [np.frombuffer(rows.column(name)[i].as_buffer(), KINDS[name]) for name in names]


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Bounds of the runs of equal keys."""
    if not len(keys[0]):
        return np.zeros(1, np.int64)
    new = np.zeros(len(keys[0]) - 1, bool)
    for key in keys:
        new |= key[1:] != key[:-1]
    return np.r_[0, np.flatnonzero(new) + 1, len(keys[0])]


def _dealt(bucket: np.ndarray, part: np.ndarray, word: np.ndarray, columns: dict[str, np.ndarray]) -> dict[str, pa.Array]:
    """Rows per (bucket, part) of entries sorted by these and the word: words, how many entries each has, and the columns."""
    word_bounds = _runs(bucket, part, word)
    first = word_bounds[:-1]
    row_bounds = _runs(bucket[first], part[first])
    entry_bounds = np.r_[word_bounds[row_bounds[:-1]], len(word)]
    return {
        "bucket": pa.array(bucket[first][row_bounds[:-1]].astype(np.int32)),
        "part": pa.array(part[first][row_bounds[:-1]].astype(np.int32)),
        "words": pack("words", word[first], row_bounds),
        "sizes": pack("sizes", np.diff(word_bounds), row_bounds),
        **{name: pack(name, values, entry_bounds) for name, values in columns.items()},
    }


def _flushes(batches: Iterator[pa.RecordBatch], keep: list[str]) -> Iterator[tuple[list[Tokens], list[pa.RecordBatch]]]:
    """Tokens of runs of rows of about FLUSH tokens, with the columns ``keep`` of these rows."""
    held, rows, size, docs = [], [], 0, 0
    for batch in batches:
        for texts in pieces(batch.column("text")):
            for at in range(0, len(texts), MAX_DOCS):
                part = Texts(
                    texts.data[texts.bounds[at] : texts.bounds[min(at + MAX_DOCS, len(texts))]],
                    texts.bounds[at : at + MAX_DOCS + 1] - texts.bounds[at], texts.first + at,
                )
                if held and (size >= FLUSH or docs + len(part) > MAX_DOCS):
                    yield held, rows
                    held, rows, size, docs = [], [], 0, 0
                held.append(Tokens(part))
                # A copy of what is kept, as a slice would hold on to the texts.
                rows.append(batch.select(keep).slice(part.first, len(part)).take(pa.array(np.arange(len(part)))))
                size += len(held[-1].values)
                docs += len(part)
    if held:
        yield held, rows


PAIRS = "bucket int, part int, words binary, sizes binary, ctx binary, n binary"


def count_pairs(docs: DataFrame, vocabulary) -> DataFrame:
    """Rows of :data:`PAIRS`: the contexts of each word and how often it stands there, one row per bucket.

    Buckets hold words, so a word meets all its contexts. A hot word has a bucket
    of its own, whose contexts are added up in parts before they come together.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, _ in _flushes(batches, []):
            flush = Flush(held, vocabulary.value)
            pairs, n = np.unique(flush.rank << 16 | flush.context, return_counts=True)
            rank, ctx = pairs >> 16, pairs & (CONTEXTS - 1)
            part = np.where(flush.hot[rank] >= 0, ctx * PARTS // CONTEXTS, 0)
            order = np.argsort(flush.bucket[rank], kind="stable")
            rank, ctx, part, n = rank[order], ctx[order], part[order], n[order]
            rows = _dealt(flush.bucket[rank], part, flush.words[rank], {"ctx": ctx, "n": n})
            yield pa.RecordBatch.from_arrays(list(rows.values()), names=list(rows))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, ["bucket", "part"]):
            for first, last in zip(bounds[:-1], bounds[1:]):
                names = ("words", "sizes", "ctx", "n")
                words, sizes, ctx, n = (np.concatenate(c) for c in zip(*(unpack(table, i, *names) for i in range(first, last))))
                known, rank = np.unique(words, return_inverse=True)
                pairs, place = np.unique(np.repeat(rank, sizes) << 16 | ctx, return_inverse=True)
                total = np.bincount(place, weights=n, minlength=len(pairs))
                key = np.zeros(len(pairs), np.int64)
                bucket, part = (table.column(c)[first].as_py() for c in ("bucket", "part"))
                rows = _dealt(key + bucket, key + part, known[pairs >> 16], {"ctx": pairs & (CONTEXTS - 1), "n": total})
                yield pa.RecordBatch.from_arrays(list(rows.values()), names=list(rows))

    keys = ["bucket", "part"]
    found = docs.mapInArrow(count, PAIRS).repartition(*keys).sortWithinPartitions(*keys)
    return found.mapInArrow(add_up, PAIRS)


def joined_parts(pairs: DataFrame, buckets: int) -> DataFrame:
    """One row per hot word from its parts, next to the other buckets. A word has at most CONTEXTS pairs."""
    cold = pairs.where(F.col("bucket") < buckets).select("bucket", "words", "sizes", "ctx", "n")
    parts = F.sort_array(F.collect_list(F.struct("part", "ctx", "n")))
    hot = pairs.where(F.col("bucket") >= buckets).groupBy("bucket").agg(F.first("words").alias("words"), parts.alias("parts"))
    joined = lambda name: F.aggregate("parts", F.lit(b""), lambda all_, part: F.concat(all_, part[name])).alias(name)
    # A row without sizes holds one word.
    return cold.unionAll(hot.select("bucket", "words", F.lit(None).cast("binary").alias("sizes"), joined("ctx"), joined("n")))


@dataclass(frozen=True)
class Totals:
    """Tables in each context, and tables and their sum in the parent restaurant: what buckets share between rounds."""

    tables: np.ndarray
    root_customers: int
    root_tables: int


STATE = "bucket int, words binary, sizes binary, ctx binary, n binary, t binary, t_sum binary, root_t binary, roots binary"


def _sizes(row: pa.RecordBatch, i: int) -> np.ndarray:
    """How many pairs each word of a row has."""
    if row.column("sizes")[i].is_valid:
        return unpack(row, i, "sizes")[0]
    return np.array([len(unpack(row, i, "ctx")[0])])


def totals(state: DataFrame) -> Totals:
    """Sums over all buckets. A task gives one row of at most CONTEXTS numbers.

    Before the first round every pair is at one table, and every word at one of the parent.
    """
    seated = "t" in state.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, root = np.zeros(CONTEXTS, np.int64), 0
        for batch in batches:
            for i in range(batch.num_rows):
                (ctx,) = unpack(batch, i, "ctx")
                tables += np.bincount(ctx, minlength=CONTEXTS)
                if not seated:
                    root += len(unpack(batch, i, "words")[0])
                    continue
                n, t, root_t = unpack(batch, i, "n", "t", "root_t")
                tables += np.bincount(ctx[n > 1], weights=t - 1, minlength=CONTEXTS).astype(np.int64)
                root += int(root_t.sum())
        some = np.flatnonzero(tables)
        codes, sums = np.r_[some, -1], np.r_[tables[some], root]
        yield pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int32)), pa.array(sums)], names=["ctx", "t"])

    read = ("ctx", "n", "t", "root_t") if seated else ("ctx", "words")
    found = state.select(*read).mapInArrow(run, "ctx int, t long").groupBy("ctx").agg(F.sum("t").alias("t")).toArrow()
    codes, sums = found.column("ctx").to_numpy(), found.column("t").to_numpy()
    tables = np.zeros(CONTEXTS, np.int64)
    tables[codes[codes >= 0]] = sums[codes >= 0]
    return Totals(tables, int(tables.sum()), int(sums[codes < 0].sum()))


def sample_round(state: DataFrame, number: int, shared: Totals, types: int, prior: Prior) -> DataFrame:
    """One round of Gibbs sampling in every bucket, under the totals of the round before.

    First the customers of the contexts: each pair's are moved with the parent's
    probability of the word as it is seated now. Their tables are the parent's
    customers, which are then seated again. Rounds after the burn-in add their
    tables to ``t_sum`` and append each word's customers in the parent, less
    discounted tables, to ``roots``.
    """
    known = state.sparkSession.sparkContext.broadcast(shared)
    burn_in = number <= prior.burn_in

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = known.value
        base = (prior.root_strength + prior.root_discount * own.root_tables) / (types + 1)
        weights = prior.strength + prior.discount * own.tables
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                bucket, sizes = row.column("bucket")[0].as_py(), _sizes(row, 0)
                words, ctx, n = unpack(row, 0, "words", "ctx", "n")
                # The same draws when a lost task runs again.
                rng = np.random.default_rng([number, bucket])
                first = np.cumsum(sizes) - sizes
                # Pairs that occur once are at one table for good.
                many = np.flatnonzero(n > 1)
                t = np.ones(len(n), np.int64)
                if number == 1:
                    t_sum, root_t, roots = np.zeros(len(many), np.int64), np.ones(len(words), np.int64), np.empty(0)
                else:
                    t[many], t_sum, root_t, roots = unpack(row, 0, "t", "t_sum", "root_t", "roots")
                customers = np.add.reduceat(t, first)
                parent = (customers - prior.root_discount * root_t + base) / (prior.root_strength + own.root_customers)
                a = weights[ctx[many]] * np.repeat(parent, sizes)[many]
                c = n[many].astype(np.int64)
                moved = seat(c, a, prior.discount, rng) if number == 1 else t[many]
                t[many] = moved = reseat(c, moved, a, prior.discount, prior.moves, rng)
                customers = np.add.reduceat(t, first)
                opening = np.full(len(sizes), base)
                root_t = seat(customers, opening, prior.root_discount, rng)
                root_t = reseat(customers, root_t, opening, prior.root_discount, prior.moves, rng)
                if not burn_in:
                    t_sum = t_sum + moved
                    roots = np.r_[roots, customers - prior.root_discount * root_t]
                made = {"words": words, "sizes": sizes, "ctx": ctx, "n": n, "t": moved, "t_sum": t_sum, "root_t": root_t, "roots": roots}
                packed = [pack(name, values, np.array([0, len(values)])) for name, values in made.items()]
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), *packed], names=["bucket", *made])

    return state.mapInArrow(run, STATE)


@dataclass(frozen=True)
class Model:
    """A sampled model: a written table of buckets, and what tasks share."""

    vocabulary: Vocabulary
    state: DataFrame
    samples: list[Totals]
    prior: Prior


def learn(docs: DataFrame, text_col: str = "text", prior: Prior = Prior()) -> Model:
    """Learn from all texts of ``docs``; null texts count as empty. Each round is written to the shared folder."""
    texts = docs.select(F.col(text_col).alias("text"))
    words = materialize(count_words(texts), "word-counts")
    vocabulary = Vocabulary.of(words)
    release(words)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    pairs = materialize(count_pairs(texts, shared), "pairs")
    state = joined_parts(pairs, vocabulary.buckets)
    known, samples = totals(pairs), []
    for number in range(1, prior.burn_in + prior.samples + 1):
        before, state = state, materialize(sample_round(state, number, known, vocabulary.types, prior), f"round-{number}")
        release(pairs if number == 1 else before)
        known = totals(state)
        if number > prior.burn_in:
            samples.append(known)
    return Model(vocabulary, state, samples, prior)


class Bucket:
    """The probabilities of a bucket's words, averaged over the samples."""

    def __init__(self, model: "Shared", words: np.ndarray, sizes: np.ndarray, ctx: np.ndarray, n: np.ndarray, t_sum: np.ndarray, roots: np.ndarray):
        self.model, self.words = model, words
        count = len(model.samples)
        self.pairs = np.repeat(np.arange(len(words)), sizes) << 16 | ctx
        self.own = n - model.prior.discount
        self.own[n > 1] = n[n > 1] - model.prior.discount * t_sum / count
        self.n = np.add.reduceat(n, np.cumsum(sizes) - sizes, dtype=np.int64) if len(words) else np.zeros(0, np.int64)
        customers = roots.reshape(count, -1) if len(words) else np.zeros((count, 0))
        # The last column is that of a word without customers.
        self.roots = np.array(
            [(np.r_[c, 0.0] + base) / whole for c, base, whole in zip(customers, model.bases, model.wholes)]
        )

    def score(self, words: np.ndarray, sizes: np.ndarray, ctx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log10 probability of each token, and the training count of its word."""
        at = np.searchsorted(self.words, words)
        at = np.where((at < len(self.words)) & (self.words[np.minimum(at, len(self.words) - 1)] == words), at, len(self.words)) if len(self.words) else np.zeros(len(words), np.int64)
        word, context = np.repeat(at, sizes), ctx.astype(np.int64)
        chance = np.zeros(len(ctx))
        for root, weight in zip(self.roots, self.model.weights):
            chance += weight[context] * root[word]
        chance /= len(self.model.weights)
        if len(self.pairs):
            key = word << 16 | context
            place = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            seen = self.pairs[place] == key
            chance[seen] += self.own[place[seen]]
        chance /= self.model.prior.strength + self.model.after[context]
        return np.log10(chance), np.repeat(np.r_[self.n, 0][at], sizes)


class Shared:
    """What scoring tasks know of the whole model."""

    def __init__(self, model: Model):
        self.prior, self.samples, self.after = model.prior, model.samples, model.vocabulary.after
        types = model.vocabulary.types + 1
        self.bases = [(model.prior.root_strength + model.prior.root_discount * s.root_tables) / types for s in model.samples]
        self.wholes = [model.prior.root_strength + s.root_customers for s in model.samples]
        self.weights = [model.prior.strength + model.prior.discount * s.tables for s in model.samples]


class Sums:
    """Sums per document of each hand-over, held by a task until they are many."""

    def __init__(self):
        self.held: dict[int, np.ndarray] = {}
        self.size = 0

    def add(self, first: int, doc: np.ndarray, *values: np.ndarray) -> None:
        """Add ``values`` to the documents ``doc`` of the hand-over that begins with row ``first``."""
        new = np.array([np.bincount(doc, weights=v) for v in values])
        old = self.held.get(first)
        if old is None:
            self.held[first] = new
            self.size += new.shape[1]
        elif old.shape[1] >= new.shape[1]:
            old[:, : new.shape[1]] += new
        else:
            new[:, : old.shape[1]] += old
            self.held[first] = new
            self.size += new.shape[1] - old.shape[1]

    def take(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``(first, documents, their sums)``; documents that nothing was added to are left out."""
        for first, sums in self.held.items():
            some = np.flatnonzero(sums[-1])
            yield first, some, sums[:, some]
        self.held, self.size = {}, 0


# How tokens, the model, documents and their sums are laid out on the way: each row has some of these.
DEALT = (
    "bucket int, part int, words binary, sizes binary, ctx binary, doc binary, first long, "
    "ids array<{id}>, held array<boolean>, n_tokens binary, sums binary"
)


def _rows(columns: dict[str, pa.Array], schema: pa.Schema) -> pa.RecordBatch:
    """A batch with nulls in the columns that are not given."""
    count = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(count, f.type) for f in schema], schema=schema)


def score_texts(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", held: Column | None = None) -> DataFrame:
    """``(<id_col>, held_out, n_tokens, n_known, train_tokens, base_score, score)``, one row per input row.

    Tokens meet the model in the shuffle: both are dealt by the word's bucket,
    where every token has all that its probability needs. What goes back is a
    row per task and hand-over with the sums of its documents. The tokens of a
    hot word are dealt over several tasks, and its model row is repeated for each.
    """
    vocabulary, context = model.vocabulary, docs.sparkSession.sparkContext
    known, shared = context.broadcast(vocabulary), context.broadcast(Shared(model))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"),
        F.coalesce(held if held is not None else held_out(F.col(id_col)), F.lit(False)).alias("held_out"), F.col(text_col).alias("text"),
    )
    id_type = docs.schema[id_col].dataType
    dealt = T._parse_datatype_string(DEALT.format(id=id_type.simpleString()))
    arrow = to_arrow_schema(dealt)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = known.value
        parts = np.r_[-(-own.hot_counts // HOT), 1]
        for number, (tokens, given) in enumerate(_flushes(batches, ["row", "id", "held_out"])):
            flush = Flush(tokens, own)
            table = pa.Table.from_batches(given).combine_chunks()
            # Row numbers are consecutive in a task, so a document is told by its place in the hand-over.
            first = table.column("row")[0].as_py()
            part = np.where(flush.hot >= 0, (number + first // MAX_DOCS) % parts[flush.hot], 0)
            order = np.argsort((flush.bucket[flush.rank] * len(flush.words) + flush.rank) << 16 | flush.context, kind="stable")
            rank = flush.rank[order]
            made = _dealt(flush.bucket[rank], part[rank], flush.words[rank], {"ctx": flush.context[order], "doc": flush.doc[order]})
            yield _rows(made | {"first": pa.array(np.full(len(made["bucket"]), first))}, arrow)
            whole = np.array([0, table.num_rows])
            heads = {c: pa.ListArray.from_arrays(pa.array(whole, pa.int32()), table.column(k).combine_chunks()) for c, k in (("ids", "id"), ("held", "held_out"))}
            heads |= {"bucket": pa.array([first % own.buckets], pa.int32()), "part": pa.array([0], pa.int32()), "first": pa.array([first])}
            yield _rows(heads | {"n_tokens": pack("n_tokens", np.concatenate([t.counts for t in tokens]), whole)}, arrow)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, key, bucket, sums = shared.value, None, None, Sums()
        empty = [np.empty(0, KINDS[c]) for c in ("words", "sizes", "ctx", "n", "t_sum", "roots")]
        for batch in batches:
            head = batch.filter(batch.column("ids").is_valid())
            if head.num_rows:
                yield head.select(out.names)
            for i in np.flatnonzero(batch.column("words").is_valid().to_numpy(zero_copy_only=False)):
                place = batch.column("bucket")[i].as_py(), batch.column("part")[i].as_py()
                if batch.column("n")[i].is_valid:
                    words, ctx, n, t_sum, roots = unpack(batch, i, "words", "ctx", "n", "t_sum", "roots")
                    key, bucket = place, Bucket(model, words, _sizes(batch, i), ctx, n, t_sum, roots)
                    continue
                if key != place:  # a bucket without training words
                    key, bucket = place, Bucket(model, *empty)
                words, sizes, ctx, doc = unpack(batch, i, "words", "sizes", "ctx", "doc")
                scores, n = bucket.score(words, sizes, ctx)
                sums.add(batch.column("first")[i].as_py(), doc, n > 0, np.log10(n + ADDED) - base, scores)
                if sums.size >= HELD:
                    yield from taken(sums)
        yield from taken(sums)

    def taken(sums: Sums) -> Iterator[pa.RecordBatch]:
        for first, doc, values in sums.take():
            whole = np.array([0, len(doc)])
            made = {"first": pa.array([first]), "doc": pack("doc", doc, whole), "sums": pack("sums", values.reshape(-1), whole * len(values))}
            yield _rows(made, out)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in whole_groups(batches, ["first"]):
            for start, end in zip(bounds[:-1], bounds[1:]):
                (head,) = (i for i in range(start, end) if table.column("ids")[i].is_valid)
                (counts,) = unpack(table, head, "n_tokens")
                total = np.zeros((3, len(counts)))
                for i in range(start, end):
                    if i != head:
                        doc, values = unpack(table, i, "doc", "sums")
                        total[:, doc] += values.reshape(3, -1)
                ids, held = (table.column(c)[head].values for c in ("ids", "held"))
                columns = [ids, held, pa.array(counts.astype(np.int64)), pa.array(np.rint(total[0]).astype(np.int64)), pa.array(total[1]), pa.array(total[2])]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    hot = [(vocabulary.buckets + i, int(-(-n // HOT))) for i, n in enumerate(vocabulary.hot_counts)]
    repeats = docs.sparkSession.createDataFrame(hot, "bucket int, parts int")
    learned = model.state.join(F.broadcast(repeats), "bucket", "left").select(
        "bucket", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"), "words", "sizes", "ctx", "n", "t_sum", "roots"
    )
    both = learned.unionByName(rows.mapInArrow(deal, dealt), allowMissingColumns=True)
    # The model's row of a bucket comes before the tokens.
    met = both.repartition("bucket", "part").sortWithinPartitions("bucket", "part", F.col("n").isNull())
    base = np.log10(max(vocabulary.tokens + ADDED * (vocabulary.types + 1), ADDED))
    out = pa.schema([arrow.field(c) for c in ("first", "doc", "ids", "held", "n_tokens", "sums")])
    sent = T.StructType([dealt[c] for c in out.names])
    result = T.StructType([T.StructField("id", id_type), *T._parse_datatype_string("held_out boolean, n_tokens long, n_known long, base_score double, score double").fields])
    found = met.mapInArrow(score, sent).repartition("first").sortWithinPartitions("first").mapInArrow(finish, result)
    return found.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(vocabulary.tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prior: Prior = Prior()) -> DataFrame:
    """``(<id_col>, held_out, n_tokens, n_known, train_tokens, base_score, score)`` of every row, learned from those not held out.

    ``score`` is the log10 probability of a whole text: of each token given the
    word before it, the end of the text included. A context's restaurant serves
    the words that follow it; its new tables are customers of the one parent
    restaurant that all contexts share, whose own tables draw from the uniform
    distribution over the words of the training texts and one unknown word.
    Seatings are sampled by Gibbs: within a round every restaurant is sampled
    under the totals of the round before, so buckets of words need only exchange
    one number per context. Probabilities are averaged over the sampled rounds;
    ``10 ** (-sum(score) / sum(n_tokens))`` is the perplexity.

    The 64,512 most frequent words and the start of a text have a restaurant
    each; the words beyond share 1,023. Words are told apart by 64 bits of hash
    (0.03 pairs share one among a billion words). A word's draws depend on its
    bucket and round only, so scores are the same when a task runs again.

    Null texts count as empty and have one token, the end. Rows with a null id
    are never held out. Repeated rows count and are scored each; other columns
    are not read; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    model = learn(rows.where(~held_out(F.col("id"))), "text", prior)
    return score_texts(rows, model, "id", "text").withColumnRenamed("id", id_col)
