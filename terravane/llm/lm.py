"""Language-model scoring with a log-bilinear model.

Tokens are lower-cased words, then one end of text.  Counts of all training
tokens are gathered over the whole corpus.  The model has ``side * side`` outputs,
a number that grows with the vocabulary up to ``SIDE``: the most frequent tokens
have half of the outputs to themselves, and every other token belongs to one of
the rest by its hash, within which it has its smoothed share of the counts.
Probabilities over all known tokens, and one unknown token for each shared output,
sum to 1.

The vectors of the ``CONTEXT`` tokens before a token are summed, r = C1[c1] +
C2[c2], and the output o = (class a, member m) is predicted in two steps:
``p(o | c) = softmax(U r + d)[a] * softmax(Q_a r + b_a)[m]``.  The model is trained
in numpy with noise-contrastive estimation of both steps.  Training texts are
dealt into shards by hashes; every shard is trained on in a fixed order from the
same start, and the mean of the shards, weighted for each row by its use, is the
next round's start.  Neither the shards nor their order depend on partitions.
Each text is used in one round.  For scoring, batched matrix products give the
normalised log-probabilities of both steps.

Counts of the ``TABLE`` most frequent tokens are broadcast (a fixed bound, chosen
by a count threshold); rarer tokens meet their counts in a shuffled join.

Nulls and empty texts consist of their end.  A null id counts as not held out.
Texts of any length are scored whole; training cuts them into pieces that keep
their contexts.  Repeated rows are separate texts, each with its own score; those
equal in id and text are trained on in one shard, piece by piece.  Tokens of equal
count are ordered by hash.  Without training tokens all probabilities come from
the smoothing; an empty table gives no rows.  Other columns are not read, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.llm import _spark, _text

WIDTH, CONTEXT, SIDE, PER_OUTPUT = 24, 2, 128, 64
TABLE, ROUNDS, BATCH, NOISE, NOISE_MEMBERS, RATE = 1 << 19, 2, 1 << 14, 32, 16, 0.08
#: training tokens of a shard (more of them beyond ``MOST_SHARDS``), of one pass, and of a piece of a text
SHARD, MOST_SHARDS, PASS, PIECE = 2_000_000, 4096, 2_000_000, 1 << 16
END = np.uint64(0x45_4E_44)
SMOOTH = 0.1
#: rows of a parameter that are added up together
BLOCK_ROWS = 1024


def token_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each text with its end, and the first of each text."""
    words, first = _text.words(*_text.column_bytes(column))
    n = len(first) - 1
    out = np.full(len(words) + n, END)
    place = np.arange(len(words)) + np.repeat(np.arange(n), np.diff(first))
    out[place] = words
    return out, first + np.arange(n + 1)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(counts, at) if len(at) else counts


def count_tokens(train: DataFrame) -> DataFrame:
    """``token`` and ``n`` over all of ``train`` (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
        size = 0
        for batch in batches:
            for part in _text.slices(batch, "text"):
                parts.append(np.unique(token_hashes(part.column(0))[0], return_counts=True))
                size += len(parts[-1][0])
                if size > 2_000_000:
                    parts = [_merged(parts)]
                    size = len(parts[0][0])
                    if size > 1_000_000:
                        yield from rows(*parts[0])
                        parts, size = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))], 0
        yield from rows(*_merged(parts))

    def rows(keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(keys), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(keys[a : a + 100_000].view(np.int64)), pa.array(counts[a : a + 100_000].astype(np.int64))], ["token", "n"])

    return train.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


class Vocabulary:
    """The broadcast part of the counts, most frequent first, and the outputs.

    ``shared``: (total, distinct) of all tokens by ``bucket_of``, those with an
    output of their own included.
    """

    def __init__(self, tokens: np.ndarray, counts: np.ndarray, total: int, distinct: int, side: int, shared: tuple[np.ndarray, np.ndarray]):
        order = np.lexsort((tokens, -counts))
        self.tokens, self.counts = tokens[order], counts[order]
        self.total, self.distinct, self.side = total, distinct, side
        self.half = side * side // 2
        self.kind = np.int16 if side * side < 1 << 15 else np.int32  # of outputs; short ones are sorted faster
        self.n_own = min(self.half, len(tokens))
        bucket = self.bucket_of(self.tokens[: self.n_own])
        mass = shared[0] - np.bincount(bucket, self.counts[: self.n_own], self.half)
        kinds = shared[1] - np.bincount(bucket, minlength=self.half)
        #: log10 of what the smoothed counts of a shared output add up to, its unknown token included
        weight = mass + SMOOTH * (kinds + 1)
        self.share = np.log10(weight)
        unigram = np.zeros(side * side)
        unigram[: self.n_own] = self.counts[: self.n_own]
        unigram[self.half :] = weight
        self.unigram = unigram / unigram.sum()

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_table"}

    def bucket_of(self, tokens: np.ndarray) -> np.ndarray:
        return (tokens >> np.uint64(20)).astype(np.int64) & (self.half - 1)

    def index(self, tokens: np.ndarray) -> np.ndarray:
        if not hasattr(self, "_table"):
            self._table = _text.HashTable(self.tokens, np.arange(len(self.tokens)))
        return self._table.get(tokens)

    def outputs(self, tokens: np.ndarray, index: np.ndarray) -> np.ndarray:
        own = (index >= 0) & (index < self.n_own)
        return np.where(own, index, self.half + self.bucket_of(tokens)).astype(self.kind)

    def levels(self) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of the classes, and of the members in each class, by counts."""
        members = self.unigram.reshape(self.side, self.side)
        classes = members.sum(1)
        return classes, members / np.maximum(classes, 1e-300)[:, None]


def side_of(total: int, distinct: int) -> int:
    """Classes, and members of each: a power of two, up to ``SIDE``.

    Two outputs for each token suffice, and each output has ``PER_OUTPUT`` training tokens or more.
    """
    side = 4
    while side < SIDE and side * side < 2 * distinct and 4 * side * side * PER_OUTPUT <= total:
        side *= 2
    return side


def padded(tokens: np.ndarray, first: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """``CONTEXT`` times ``start`` before each text; new offsets."""
    n = len(first) - 1
    out = np.full(len(tokens) + CONTEXT * n, start, tokens.dtype)
    out[np.arange(len(tokens)) + CONTEXT * (1 + np.repeat(np.arange(n), np.diff(first)))] = tokens
    return out, first + CONTEXT * np.arange(n + 1)


def samples(ids: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Tokens and their contexts, nearest first, of texts that begin with ``CONTEXT`` ids of context."""
    inner = np.ones(len(ids), bool)
    for k in range(CONTEXT):
        inner[first[:-1] + k] = False
    at = np.flatnonzero(inner)
    return [ids[at - k] for k in range(CONTEXT + 1)]


def start_model(vocabulary: Vocabulary, seed: int = 3) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    size, side = len(vocabulary.unigram), vocabulary.side
    classes, members = vocabulary.levels()
    model = {f"C{j}": rng.normal(0, 0.1, (size + 1, WIDTH)) for j in range(1, CONTEXT + 1)}
    model |= {"U": rng.normal(0, 0.1, (side, WIDTH)), "Q": rng.normal(0, 0.1, (size, WIDTH))}
    model["Q"][vocabulary.unigram == 0] = 0
    model["U"][classes == 0] = 0
    # an output that no token has gets no probability
    model |= {"d": np.log(np.maximum(classes, 1e-26)), "b": np.log(np.maximum(members, 1e-26)).reshape(-1)}
    return {k: v.astype(np.float32) for k, v in model.items()}


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Trainer:
    """One shard's copy of the model; ``used`` counts the use of each row."""

    def __init__(self, model: dict[str, np.ndarray], vocabulary: Vocabulary):
        self.model = {k: v.copy() for k, v in model.items()}
        self.squares = {k: np.full(len(v), 1e-2, np.float32) for k, v in model.items()}
        self.used = {k: np.zeros(len(v)) for k, v in model.items()}
        self.side = vocabulary.side
        classes, members = vocabulary.levels()
        self.classes, self.members = np.cumsum(classes), np.cumsum(members, 1)
        self.shift_d = np.log(np.maximum(classes, 1e-26) * NOISE).astype(np.float32)
        self.shift_b = np.log(np.maximum(members, 1e-26) * NOISE_MEMBERS).reshape(-1).astype(np.float32)

    def step(self, name: str, rows: np.ndarray, gradient: np.ndarray, uses: np.ndarray | int = 1) -> None:
        """AdaGrad; rows that occur several times are added up first."""
        order = np.argsort(rows, kind="stable")
        rows = rows[order]
        at = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        own, g = rows[at], np.add.reduceat(gradient[order], at, axis=0)
        self.used[name][own] += np.diff(np.append(at, len(rows))) if isinstance(uses, int) else np.add.reduceat(uses[order], at)
        wide = g.ndim > 1
        squares = self.squares[name][own] + (np.einsum("ij,ij->i", g, g) / g.shape[1] if wide else g * g)
        self.squares[name][own] = squares
        size = RATE / np.sqrt(squares)
        self.model[name][own] += g * (size[:, None] if wide else size)

    def batch(self, rng: np.random.Generator, o: np.ndarray, *contexts: np.ndarray) -> None:
        """Noise-contrastive steps of both levels on (output, contexts)."""
        m, side = self.model, self.side
        order = np.argsort(o, kind="stable")
        o, contexts = o[order], [c[order] for c in contexts]
        scale = np.float32(64 / len(o))
        at = np.flatnonzero(np.append(True, o[1:] != o[:-1]))  # first row of each output
        times = np.diff(np.append(at, len(o)))
        outputs = o[at].astype(np.int64)
        first = np.flatnonzero(np.append(True, outputs[1:] // side != outputs[:-1] // side))  # first output of each class
        edges, classes = at[first], outputs[first] // side
        sizes = np.diff(np.append(edges, len(o)))
        r = sum(m[f"C{j}"][c] for j, c in enumerate(contexts, 1))
        # classes
        noise = np.minimum(np.searchsorted(self.classes, rng.random(NOISE) * self.classes[-1]), side - 1)
        u = np.repeat(m["U"][classes], sizes, axis=0)
        good = _sigmoid(-(np.einsum("ij,ij->i", r, u) + np.repeat(m["d"][classes] - self.shift_d[classes], sizes))) * scale
        bad = -_sigmoid(r @ m["U"][noise].T + (m["d"][noise] - self.shift_d[noise])) * scale
        dr = u
        dr *= good[:, None]
        dr += bad @ m["U"][noise]
        du = np.concatenate([np.add.reduceat(good[:, None] * r, edges), bad.T @ r])
        dd = np.concatenate([np.add.reduceat(good, edges), bad.sum(0)])
        # members of each class
        q = np.repeat(m["Q"][outputs], times, axis=0)
        good = _sigmoid(-(np.einsum("ij,ij->i", r, q) + np.repeat(m["b"][outputs] - self.shift_b[outputs], times))) * scale
        q *= good[:, None]
        dr += q
        np.multiply(r, good[:, None], out=q)
        rows, dq, db, uses = [outputs], [np.add.reduceat(q, at)], [np.add.reduceat(good, at)], [times]
        draws = rng.random((len(edges), NOISE_MEMBERS))
        for k, (lo, n) in enumerate(zip(edges.tolist(), sizes.tolist(), strict=True)):
            own = self.members[classes[k]]
            chosen = classes[k] * side + np.minimum(np.searchsorted(own, draws[k] * own[-1]), side - 1)
            near, far = r[lo : lo + n], m["Q"][chosen]
            x = near @ far.T
            x += m["b"][chosen] - self.shift_b[chosen]
            np.clip(x, -30, 30, out=x)
            np.negative(x, out=x)
            np.exp(x, out=x)
            x += 1
            np.divide(-scale, x, out=x)
            dr[lo : lo + n] += x @ far
            rows.append(chosen)
            dq.append(x.T @ near)
            db.append(x.sum(0))
        uses.append(np.ones(len(edges) * NOISE_MEMBERS, np.int64))
        rows, uses = np.concatenate(rows), np.concatenate(uses)
        both = np.concatenate([classes, noise])
        used = np.concatenate([sizes, np.ones(NOISE, np.int64)])
        self.step("U", both, du, used)
        self.step("d", both, dd, used)
        self.step("Q", rows, np.concatenate(dq), uses)
        self.step("b", rows, np.concatenate(db), uses)
        for j, c in enumerate(contexts, 1):
            self.step(f"C{j}", c, dr)

    def learn(self, seed: int, o: np.ndarray, *contexts: np.ndarray) -> None:
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(o))
        for at in range(0, len(o), BATCH):
            k = order[at : at + BATCH]
            self.batch(rng, o[k], *(c[k] for c in contexts))


def _pieces(texts: DataFrame, vocabulary, turn: int, n_shards: int) -> DataFrame:
    """``shard``, ``rank`` and ``ids`` of the pieces of the texts of one round."""
    chosen = texts.filter(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(ROUNDS)) == turn)
    chosen = chosen.select(F.xxhash64("doc_id").alias("name"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary.value
        start = len(vocab.unigram)
        for batch in batches:
            for part in _text.slices(batch, "text"):
                tokens, first = token_hashes(part.column(1))
                ids, first = padded(vocab.outputs(tokens, vocab.index(tokens)), first, start)
                size = np.diff(first) - CONTEXT
                n = -(-size // PIECE)
                text = np.repeat(np.arange(len(size)), n)
                k = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
                lo = first[:-1][text] + k * PIECE
                hi = np.minimum(lo + PIECE + CONTEXT, first[1:][text])
                held = np.concatenate([np.zeros(0, np.int64), *(np.arange(x, y) for x, y in zip(lo, hi, strict=True))])
                offsets = np.concatenate([[0], np.cumsum(hi - lo)])
                content = np.add.reduceat(_text.mix(ids[held].astype(np.uint64) + np.arange(len(held), dtype=np.uint64) - np.repeat(offsets[:-1], hi - lo).astype(np.uint64)), offsets[:-1])
                rank = _text.mix(part.column(0).to_numpy().view(np.uint64)[text] + k.astype(np.uint64) + content)
                shard = (rank >> np.uint64(11)).astype(np.int64) % n_shards
                yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(rank.view(np.int64)), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids[held].astype(np.int32)))], ["shard", "rank", "ids"])

    return chosen.mapInArrow(run, "shard long, rank long, ids array<int>")


def train_model(train: DataFrame, vocabulary) -> dict[str, np.ndarray]:
    """Rounds of training; ``train`` has doc_id and text, ``vocabulary`` is broadcast."""
    spark = train.sparkSession
    model = start_model(vocabulary.value)
    blocks = [(k, at) for k in sorted(model) for at in range(0, len(model[k]), BLOCK_ROWS)]
    n_shards = min(MOST_SHARDS, max(1, -(-vocabulary.value.total // (ROUNDS * SHARD))))
    for turn in range(ROUNDS):
        given = spark.sparkContext.broadcast(model)  # a fixed size

        def run(batches: Iterator[pa.RecordBatch], given=given) -> Iterator[pa.RecordBatch]:
            start = given.value
            shard, trainer, held, size = -1, None, [], 0

            def learn() -> None:
                nonlocal held, size
                if size:
                    trainer.learn(shard, *(np.concatenate(x) for x in zip(*held, strict=True)))
                held, size = [], 0

            def result() -> pa.RecordBatch:
                learn()
                rows = []
                for name, at in blocks:
                    used = trainer.used[name][at : at + BLOCK_ROWS]
                    moved = trainer.model[name][at : at + BLOCK_ROWS] - start[name][at : at + BLOCK_ROWS]
                    rows.append(np.concatenate([used, (moved.reshape(len(used), -1) * used[:, None]).reshape(-1)]).astype(np.float32))
                return pa.RecordBatch.from_arrays([pa.array(np.arange(len(rows))), pa.array(np.full(len(rows), shard)), pa.array(rows, pa.list_(pa.float32()))], ["i", "part", "v"])

            for batch in batches:
                shards = batch.column(0).to_numpy()
                edges = np.append(np.flatnonzero(np.append(True, shards[1:] != shards[:-1])), len(shards)) if len(shards) else [0]
                for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                    if shards[lo] != shard:
                        if trainer is not None:
                            yield result()
                        shard, trainer = int(shards[lo]), Trainer(start, vocabulary.value)
                    ids = batch.column(2).slice(lo, hi - lo)
                    first = np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy())])
                    found = samples(ids.flatten().to_numpy().astype(vocabulary.value.kind), first)
                    for at in range(0, len(found[0]), PASS):
                        held.append([x[at : at + PASS] for x in found])
                        size += len(held[-1][0])
                        if size >= PASS:
                            learn()
            if trainer is not None:
                yield result()
            _text.give_back()

        pieces = _pieces(train, vocabulary, turn, n_shards)
        parts = pieces.repartition(min(2 * n_shards, MOST_SHARDS), "shard").sortWithinPartitions("shard", "rank")
        sums = _spark.add_up(parts.mapInArrow(run, "i long, part long, v array<float>"), n_shards, "float").collect()  # one model
        model = {k: v.copy() for k, v in model.items()}
        for r in sums:
            name, at = blocks[r["i"]]
            own = model[name][at : at + BLOCK_ROWS]
            v = np.array(r["v"])
            used, moved = v[: len(own)], v[len(own) :].reshape(own.shape)
            own += moved / np.maximum(used, 1).reshape(-1, *[1] * (own.ndim - 1))
    return model


def log_probabilities(model: dict[str, np.ndarray], side: int, o: np.ndarray, *contexts: np.ndarray) -> np.ndarray:
    """Normalised natural log-probability of each output after its contexts."""
    out = np.empty(len(o), np.float32)
    # a last coordinate of 1 adds the biases inside of the products
    members = np.concatenate([model["Q"], model["b"][:, None]], 1).reshape(side, side, -1)
    classes = np.concatenate([model["U"], model["d"][:, None]], 1)
    tables = [np.pad(model[f"C{j}"], ((0, 0), (0, 1)), constant_values=1 if j == 1 else 0) for j in range(1, CONTEXT + 1)]
    for lo in range(0, len(o), ROWS_AT_ONCE):
        at = np.argsort(o[lo : lo + ROWS_AT_ONCE], kind="stable") + lo
        a, k = np.divmod(o[at].astype(np.int64), side)
        r = tables[0][contexts[0][at]]
        for table, c in zip(tables[1:], contexts[1:], strict=True):
            r += table[c[at]]
        found = np.concatenate([_log_share(r[i : i + SCORES_AT_ONCE], classes, a[i : i + SCORES_AT_ONCE]) for i in range(0, len(a), SCORES_AT_ONCE)])
        edges = np.append(np.flatnonzero(np.append(True, a[1:] != a[:-1])), len(a))
        for i, end in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            own = members[a[i]]
            for i in range(i, end, SCORES_AT_ONCE):
                j = min(i + SCORES_AT_ONCE, end)
                found[i:j] += _log_share(r[i:j], own, k[i:j])
        out[at] = found
    return out


#: tokens that are sorted together, and rows of scores that are held at once (2 MB)
ROWS_AT_ONCE, SCORES_AT_ONCE = 1 << 17, 1 << 12


def _log_share(r: np.ndarray, vectors: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Logarithm of the softmax of ``r @ vectors.T`` at ``chosen``."""
    s = r @ vectors.T
    own = s[np.arange(len(s)), chosen]
    with np.errstate(over="ignore", divide="ignore"):
        out = own - np.log(np.exp(s, out=s).sum(1))
    odd = np.flatnonzero(~np.isfinite(out))
    if len(odd):
        s = r[odd] @ vectors.T
        top = s.max(1)
        out[odd] = own[odd] - top - np.log(np.exp(s - top[:, None]).sum(1))
    return out


def threshold(counts: DataFrame, most: int) -> int:
    """The lowest n such that at most ``most`` rows of ``counts`` have it or more.

    Each step divides the range that holds it into 4096 parts: few rows come back
    however large the counts are.
    """
    lo, hi, above = 1, (counts.agg(F.max("n")).first()[0] or 0) + 1, 0  # rows of n >= hi: above
    while lo < hi:
        width = -(-(hi - lo) // 4096)
        inner = counts.filter((F.col("n") >= lo) & (F.col("n") < hi))
        part = F.floor((F.col("n") - lo) / width).cast("int")
        found = {r["part"]: r["count"] for r in inner.groupBy(part.alias("part")).count().collect()}
        for k in range(-(-(hi - lo) // width) - 1, -1, -1):
            n = found.get(k, 0)
            if above + n > most:
                lo, hi = lo + k * width, min(hi, lo + (k + 1) * width)
                if width == 1:
                    return hi
                break
            above += n
        else:
            return lo
    return lo


class Fitted:
    """Counts, broadcast vocabulary and model of a corpus."""

    def __init__(self, counts: DataFrame, limit: int, vocabulary, model: dict[str, np.ndarray]):
        self.counts, self.limit, self.vocabulary, self.model = counts, limit, vocabulary, model


def fit(train: DataFrame) -> Fitted:
    """The model of all rows of ``train`` (doc_id, text)."""
    spark = train.sparkSession
    counts = _spark.materialise(count_tokens(train))
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    limit = threshold(counts, TABLE)
    side = side_of(total, distinct)
    half = side * side // 2
    bucket = F.shiftrightunsigned("token", 20).bitwiseAND(F.lit(half - 1).cast("long"))
    shared = np.zeros((2, half))
    for r in counts.groupBy(bucket.alias("bucket")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).collect():  # half of the outputs
        shared[:, r["bucket"]] = r["n"], r["k"]
    top = counts.filter(F.col("n") >= limit).limit(TABLE).toArrow()  # TABLE rows or fewer, by the threshold
    tokens = top.column("token").to_numpy().view(np.uint64)
    vocabulary = spark.sparkContext.broadcast(Vocabulary(tokens, top.column("n").to_numpy(), total, distinct, side, (shared[0], shared[1])))
    return Fitted(counts, limit, vocabulary, train_model(train, vocabulary))


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    docs = docs.withColumn("held_out", _spark.held_out(F.col("doc_id"), 10, 0))
    return score(docs, fit(docs.filter("not held_out").select("doc_id", "text")))


def score(docs: DataFrame, fitted: Fitted) -> DataFrame:
    """Scores of ``docs`` (doc_id, text, held_out)."""
    vocabulary = fitted.vocabulary
    given = docs.sparkSession.sparkContext.broadcast(fitted.model)  # a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, model = vocabulary.value, given.value
        whole = np.log10(vocab.total + SMOOTH * (vocab.distinct + 1))
        logs = np.log10(vocab.counts + SMOOTH)
        start = len(vocab.unigram)
        for batch in batches:
            for part in _text.slices(batch, "text"):
                tokens, first = token_hashes(part.column(1))
                index = vocab.index(tokens)
                ids = vocab.outputs(tokens, index)
                lm = log_probabilities(model, vocab.side, *samples(*padded(ids, first, start))) / np.log(10)
                own = np.where(index >= 0, logs[np.maximum(index, 0)], 0.0) if len(logs) else np.zeros(len(index))
                shared = ids >= vocab.half
                lm = lm.astype(np.float64)
                lm[shared] += own[shared] - vocab.share[ids[shared] - vocab.half]
                at = first[:-1]
                rare = np.flatnonzero(index < 0)
                sizes = np.bincount(np.searchsorted(first, rare, "right") - 1, minlength=part.num_rows)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                cols = [part.column(0), part.column(2), pa.array(np.diff(first)), pa.array(np.add.reduceat((index >= 0).astype(np.int64), at)), pa.array(np.add.reduceat(own - whole, at)), pa.array(np.add.reduceat(lm, at)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(tokens[rare].view(np.int64)))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare"])

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare array<long>"
    scored = docs.select("doc_id", "text", "held_out").mapInArrow(run, schema)
    scored = _spark.materialise(scored.withColumn("row", F.monotonically_increasing_id()))
    known = fitted.counts.filter(F.col("n") < fitted.limit)
    rare = scored.select("row", F.explode("rare").alias("token")).join(known, "token", "left")
    rare = rare.groupBy("row").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + F.lit(SMOOTH))).alias("more"), F.count("n").alias("found"))
    out = scored.drop("rare").join(rare, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("found", F.lit(0))).alias("n_known"), F.lit(vocabulary.value.total).cast("long").alias("train_tokens"), (F.col("base_score") + more).alias("base_score"), (F.col("score") + more).alias("score"))
