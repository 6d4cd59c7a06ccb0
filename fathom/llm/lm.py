"""Document likelihoods by a gated recurrent language model.

Words are counted over all training documents.  The GRU sees the commonest words as
symbols of their own and every other word as one of a few tail symbols, by its
ending.  Its output is factored: first a class, then the word within the class; a
tail class hands over to the counts of its words.  So every word, seen or not, has a
probability.  Training is truncated backpropagation in numpy: from a common start
each task makes one pass over a fold of the training documents, and the parameters
are averaged by tokens (local SGD).  Folds and their order follow from hashes, so the
model doesn't depend on how files are split.  The state is carried across windows
from a document's first word to its end, in training and in scoring.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns, saved
from .language import fold

HIDDEN = 16
#: Symbols with a place of their own, by classes of so many; the first is the end.
VOCABULARY, CLASS = 512, 32
TAILS = 16
#: Words whose counts every task holds; those of all others are joined.
HEAD = 200_000
#: Documents side by side, and steps that a gradient goes back.
LANES, STEPS = 512, 16
RATE = 0.004
#: Logits are held below this, so that their exponentials are finite; states are
#: within one of zero, so only weights far beyond the trained ones get there.
MOST_LOGIT = np.float32(60)
#: Tokens that a step of training is made from, at least: the windows in which only
#: a few long documents are left don't each make one.
STEP_TOKENS = 4096
#: Tokens of a fold, about; beyond so many folds their number grows with the root alone.
FOLD_TOKENS, MANY_FOLDS = 1 << 21, 4096
#: Documents of the common start.
WARM_DOCS, WARM_PASSES = 400, 3
#: Distinct words that a counting task holds before it hands them on.
HELD_WORDS = 400_000


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def tail_of(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % TAILS


class Symbols(dict):
    """Symbols by word; that of any word that isn't held follows from its ending."""

    def __missing__(self, word: bytes) -> int:
        return VOCABULARY + tail_of(word)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all of docs(text); the end of a document is the word ''."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def handed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for b in batches:
            for text in b.column("text"):
                held.update(tokens(text.as_py()))
                held[b""] += 1
                if len(held) > HELD_WORDS:
                    yield handed()
        yield handed()

    return columns(docs, text="string").mapInArrow(each, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """What every task holds: the commonest words with their counts, and totals."""

    words: list[bytes]  # the end first, then by count
    counts: np.ndarray
    total: int
    distinct: int
    tail_sums: np.ndarray  # of each tail class: count of its words, how many they are

    def ready(self) -> Vocabulary:
        self.index = {w: i for i, w in enumerate(self.words)}
        self.symbol = np.array([i if i < VOCABULARY else VOCABULARY + tail_of(w) for i, w in enumerate(self.words)] or [0], np.int64)
        self.symbols: Symbols | None = None
        self.norm = np.log(self.tail_sums[:, 0] + 0.5 * (self.tail_sums[:, 1] + 1))
        self.log_count = np.log(np.append(self.counts, 0) + 0.5)
        return self

    def encode(self, words: list[bytes]) -> np.ndarray:
        """The symbol of each word, and of the end after them."""
        if self.symbols is None:
            self.symbols = Symbols(zip(self.words, self.symbol.tolist(), strict=False))
        return np.array([*map(self.symbols.__getitem__, words), 0], np.int16)

    def places(self, words: list[bytes]) -> np.ndarray:
        """Where each word, and the end after them, stands among `words`; -1: nowhere."""
        get = self.index.get
        return np.array([*[get(w, -1) for w in words], 0], np.int64)


def vocabulary(counts: DataFrame) -> Vocabulary:
    """From the written counts; HEAD words at most reach the driver."""
    # The least count with fewer than HEAD words at or above it, in steps of an eighth
    # of a doubling: a few hundred rows tell, and no task gathers the candidates.
    step = F.floor(F.log2("n") * 8)
    least, words = None, 0
    for row in counts.filter("word <> ''").groupBy(step.alias("step")).agg(F.count("*").alias("words")).orderBy(F.desc("step")).collect():
        words += row["words"]
        if words >= HEAD:
            break
        least = row["step"]
    common = counts.filter("word <> ''").filter(step >= least if least is not None else F.lit(False))
    top = common.toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    ends = counts.filter("word = ''").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    words = [b"", *(w.encode() for w in top.column("word").to_pylist())]
    total, distinct = counts.filter("n > 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    own = set(words[:VOCABULARY])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((TAILS, 2), np.int64)
        for b in batches:
            for word, n in zip(b.column("word").to_pylist(), b.column("n").to_pylist(), strict=True):
                word = word.encode()
                if word not in own:
                    out[tail_of(word)] += n, 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(TAILS)), pa.array(out[:, 0]), pa.array(out[:, 1])], ["tail", "n", "v"])

    tails = np.zeros((TAILS, 2))
    for row in counts.mapInArrow(sums, "tail long, n long, v long").groupBy("tail").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        tails[row["tail"]] = row["n"], row["v"]
    return Vocabulary(words, np.array([ends, *top.column("n").to_pylist()], np.int64), total, distinct, tails)


class Model:
    """The GRU: flat float32 parameters, a loss of windows and its gradient."""

    shapes = {
        "embed": (VOCABULARY + TAILS, HIDDEN), "into": (HIDDEN, 3 * HIDDEN), "bias": (3 * HIDDEN,), "around": (HIDDEN, 3 * HIDDEN),
        "class_w": (HIDDEN, VOCABULARY // CLASS + TAILS), "class_b": (VOCABULARY // CLASS + TAILS,), "word_w": (VOCABULARY, HIDDEN), "word_b": (VOCABULARY,),
    }

    def __init__(self, flat: np.ndarray):
        self.flat, at = flat, 0
        self.p: dict[str, np.ndarray] = {}
        for name, shape in self.shapes.items():
            n = int(np.prod(shape))
            self.p[name] = flat[at : at + n].reshape(shape)
            at += n

    @classmethod
    def size(cls) -> int:
        return sum(int(np.prod(s)) for s in cls.shapes.values())

    @classmethod
    def start(cls, v: Vocabulary) -> Model:
        """Small random weights; the biases give the unigram frequencies."""
        m = cls(np.random.default_rng(11).normal(0, 0.1, cls.size()).astype(np.float32))
        own = np.zeros(VOCABULARY)
        own[: min(VOCABULARY, len(v.counts))] = v.counts[:VOCABULARY]
        mass = own.reshape(-1, CLASS).sum(1)
        m.p["bias"][:] = 0
        m.p["class_b"][:] = np.log(np.concatenate([mass, v.tail_sums[:, 0]]) + 0.5) - np.log(v.total + 1)
        m.p["word_b"][:] = np.log(own + 0.01) - np.repeat(np.log(mass + 0.01 * CLASS), CLASS)
        return m

    def window(self, sym: np.ndarray, target: np.ndarray, keep: np.ndarray, h: np.ndarray, learn: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """One window of all lanes: log-probabilities of the targets, the state, the gradient.

        sym, target: (steps, lanes); keep: 0 where a document begins, so that the
        state does; learn: 1 for targets that count, None for no gradient.
        """
        p, H, half = self.p, HIDDEN, np.float32(0.5)
        table = p["embed"] @ p["into"] + p["bias"]
        steps, lanes = sym.shape
        hs = np.empty((steps + 1, lanes, H), np.float32)
        # Gates by step: r and z, the state's part of n, n, and the state that they began from.
        # A sigmoid is half a hyperbolic tangent of half its argument, plus a half.
        rz, own, n, start = np.empty((steps, lanes, 2 * H), np.float32), *(np.empty((steps, lanes, H), np.float32) for _ in range(3))
        two, one = table[:, : 2 * H] * half, table[:, 2 * H :]
        around_two, around_one = p["around"][:, : 2 * H] * half, np.ascontiguousarray(p["around"][:, 2 * H :])
        hs[0] = h
        for t in range(steps):
            before, gate = np.multiply(hs[t], keep[t][:, None], out=start[t]), rz[t]
            np.matmul(before, around_two, out=gate)
            gate += two[sym[t]]
            np.tanh(gate, out=gate)
            gate *= half
            gate += half
            np.matmul(before, around_one, out=own[t])
            new = np.multiply(gate[:, :H], own[t], out=n[t])
            new += one[sym[t]]
            np.tanh(new, out=new)
            after = np.subtract(before, new, out=hs[t + 1])
            after *= gate[:, H:]
            after += new
        out = hs[1:].reshape(-1, H)
        y = target.ravel()
        of = np.where(y < VOCABULARY, y // CLASS, y - VOCABULARY + VOCABULARY // CLASS).astype(np.int16)
        rows = np.arange(len(y))
        logits = np.minimum(out @ p["class_w"] + p["class_b"], MOST_LOGIT)
        chance = np.exp(logits)
        sums = chance @ np.ones(chance.shape[1], np.float32)
        logp = logits[rows, of] - np.log(sums)
        grad = None
        if learn is not None:
            grad = Model(np.zeros(len(self.flat), np.float32))
            weight = (learn.ravel() / max(learn.sum(), 1)).astype(np.float32)
            chance /= sums[:, None]
            chance[rows, of] -= 1
            chance *= weight[:, None]
            grad.p["class_w"][:], grad.p["class_b"][:] = out.T @ chance, chance.sum(0)
            dout = chance @ p["class_w"].T
        order = np.argsort(of, kind="stable")
        edges = np.searchsorted(of[order], np.arange(VOCABULARY // CLASS + 1, dtype=np.int16))
        for c in range(VOCABULARY // CLASS):
            at = order[edges[c] : edges[c + 1]]
            if not len(at):
                continue
            part = slice(c * CLASS, (c + 1) * CLASS)
            logits = np.minimum(out[at] @ p["word_w"][part].T + p["word_b"][part], MOST_LOGIT)
            chance = np.exp(logits)
            sums = chance @ np.ones(CLASS, np.float32)
            mine = (np.arange(len(at)), y[at] - c * CLASS)
            logp[at] += logits[mine] - np.log(sums)
            if grad is not None:
                chance /= sums[:, None]
                chance[mine] -= 1
                chance *= weight[at][:, None]
                grad.p["word_w"][part], grad.p["word_b"][part] = chance.T @ out[at], chance.sum(0)
                dout[at] += chance @ p["word_w"][part]
        if grad is None:
            return logp.reshape(sym.shape), hs[-1], None
        dout, dx, dh = dout.reshape(steps, lanes, H), np.empty((steps, lanes, 3 * H), np.float32), np.zeros((lanes, H), np.float32)
        # What a step multiplies by is known for all steps beforehand.
        r, z = rz[:, :, :H], rz[:, :, H:]
        by_n, by_r, by_z = (1 - z) * (1 - n * n), own * r * (1 - r), (start - n) * z * (1 - z)
        dg, back = np.empty((steps, lanes, 3 * H), np.float32), np.ascontiguousarray(p["around"].T)
        for t in range(steps - 1, -1, -1):
            dh += dout[t]
            dn = dh * by_n[t]
            np.multiply(dn, by_r[t], out=dg[t, :, :H])
            np.multiply(dh, by_z[t], out=dg[t, :, H : 2 * H])
            np.multiply(dn, r[t], out=dg[t, :, 2 * H :])
            dx[t, :, 2 * H :] = dn
            dh *= z[t]
            dh += dg[t] @ back
            dh *= keep[t][:, None]
        dx[:, :, : 2 * H] = dg[:, :, : 2 * H]
        grad.p["around"][:] = start.reshape(-1, H).T @ dg.reshape(-1, 3 * H)
        flat, s = dx.reshape(-1, 3 * H), sym.ravel().astype(np.int16)
        order = np.argsort(s, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], s[order][1:] != s[order][:-1]]))
        dtable = np.zeros_like(table)
        dtable[s[order][first]] = np.add.reduceat(flat[order], first, axis=0)
        grad.p["embed"][:], grad.p["into"][:], grad.p["bias"][:] = dtable @ p["into"].T, p["embed"].T @ dtable, dtable.sum(0)
        return logp.reshape(sym.shape), hs[-1], grad.flat


class Adam:
    def __init__(self, n: int):
        self.m, self.v, self.t = np.zeros(n, np.float32), np.zeros(n, np.float32), 0

    def step(self, flat: np.ndarray, grad: np.ndarray) -> None:
        grad = grad * np.float32(min(1, 1 / max(float(np.sqrt((grad * grad).sum())), 1e-12)))
        self.t += 1
        self.m += np.float32(0.1) * (grad - self.m)
        self.v += np.float32(0.01) * (grad * grad - self.v)
        flat -= np.float32(RATE) * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.99**self.t)) + np.float32(1e-6))


def run(model: Model, symbols: list[np.ndarray], adam: Adam | None = None) -> np.ndarray:
    """Natural log-probability of each document, its symbols' classes and words alone.

    Documents follow each other in LANES lanes of like length, each from a state of
    zeros; with adam, the windows are learned from.
    """
    sizes = np.array([len(s) for s in symbols])
    whole, starts = np.concatenate(symbols), np.concatenate([[0], np.cumsum(sizes)])
    owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    begins = np.zeros(len(whole), bool)
    begins[starts[:-1]] = True
    previous = np.roll(whole, 1)
    previous[begins] = 0
    # Lanes begin with documents, so that no document is cut.
    lanes = min(LANES, len(sizes))
    cut = np.unique(np.searchsorted(starts[:-1], np.linspace(0, len(whole), lanes + 1)[:-1]))
    first, last = starts[cut], np.append(starts[cut[1:]], len(whole))
    long_first = np.argsort(first - last, kind="stable")
    first, last = first[long_first], last[long_first]
    logp = np.zeros(len(whole))
    h = np.zeros((len(first), HIDDEN), np.float32)
    total, waiting = np.zeros(len(model.flat), np.float32), 0
    for t in range(0, int((last - first).max()), STEPS):
        live = int((last - first > t).sum())
        at = first[:live] + t + np.arange(STEPS)[:, None]
        there = at < last[:live]
        at = np.where(there, at, 0)
        keep = np.where(there & begins[at], 0, 1).astype(np.float32)
        got, h, grad = model.window(previous[at], whole[at], keep, h[:live], there.astype(np.float32) if adam else None)
        logp[at[there]] = got[there]
        if adam:
            total += grad * np.float32(there.sum())
            waiting += int(there.sum())
            if waiting >= STEP_TOKENS:
                adam.step(model.flat, total / np.float32(waiting))
                total[:], waiting = 0, 0
    return np.bincount(owner, logp, len(sizes))


def train(docs: DataFrame, held: Vocabulary) -> np.ndarray:
    """Parameters from all of docs(doc_id, text)."""
    spark = docs.sparkSession
    # Hashes alone are ordered; texts come once the last of them is known.
    hashes = docs.select(F.xxhash64("text").alias("h")).distinct().orderBy("h").limit(WARM_DOCS)
    last = hashes.agg(F.max("h")).first()[0]
    warm = docs.filter(F.xxhash64("text") <= F.lit(last)).select("text").distinct().toArrow().column("text").to_pylist() if last is not None else []
    warm.sort()
    v = held.ready()
    model = Model.start(v)
    adam = Adam(len(model.flat))
    for _ in range(WARM_PASSES if warm else 0):
        run(model, [v.encode(tokens(t)) for t in warm], adam)
    shared = spark.sparkContext.broadcast((held.words, held.counts, held.total, held.distinct, held.tail_sums, model.flat))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *parts, flat = shared.value
        v, model, adam, seen = Vocabulary(*parts).ready(), Model(flat.copy()), Adam(len(flat)), 0
        for b in batches:
            symbols = [v.encode(tokens(t.as_py())) for t in b.column("text")]
            if symbols:
                run(model, symbols, adam)
                seen += sum(map(len, symbols))
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([model.flat.tobytes()], pa.binary()), pa.array([seen])], ["flat", "seen"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(Model.size()), 0
        for b in batches:
            for flat, n in zip(b.column("flat").to_pylist(), b.column("seen").to_pylist(), strict=True):
                total += np.frombuffer(flat, np.float32).astype(np.float64) * n
                seen += n
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([seen])], ["flat", "seen"])

    folds = -(-held.total // FOLD_TOKENS) or 1
    folds = min(folds, max(MANY_FOLDS, int((MANY_FOLDS * folds) ** 0.5)))
    dealt = docs.select("text", F.xxhash64("doc_id", "text").alias("h")).repartitionById(folds, F.pmod("h", F.lit(folds)).cast("int")).sortWithinPartitions("h", "text")
    local = saved(dealt.select("text").mapInArrow(each, "flat binary, seen long"), "local")
    sums = local.repartition(16).mapInArrow(added, "flat binary, seen long").filter("seen > 0").collect()  # a row for each of 16 tasks
    if not sums:
        return model.flat
    return (sum(np.frombuffer(r["flat"]) for r in sums) / sum(r["seen"] for r in sums)).astype(np.float32)


SCORED = "uid long, doc_id long, n_tokens long, n_known long, counted double, modelled double, tail array<struct<word:string,n:long>>"


def score(docs: DataFrame, training: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Log-probabilities (base ten) of docs(doc_id, text), learned from training(doc_id, text).

    Result: doc_id, n_tokens (words and the end), n_known (those in training),
    train_tokens, base_score (by smoothed counts alone), score (by the model).

    A null or empty text is its end alone.  Without training documents the base gives
    every token the chance one and the model stays at its start.  Whole texts are
    scored; repeated rows and null ids are passed through; an empty table gives no rows.
    """
    spark = docs.sparkSession
    training = columns(training, doc_id="long", text="string").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    counts = saved(word_counts(training), "counts") if counts is None else counts
    counts = counts.filter("n > 0")
    held = vocabulary(counts)
    flat = train(training, held)
    shared = spark.sparkContext.broadcast((held.words, held.counts, held.total, held.distinct, held.tail_sums, flat))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *parts, flat = shared.value
        v, model = Vocabulary(*parts).ready(), Model(flat)
        for b in batches:
            if not b.num_rows:
                continue
            symbols, known, counted, modelled, sizes, words, times = [], [], [], [], [], [], []
            for text in b.column("text"):
                found = tokens(text.as_py())
                at = v.places(found)
                symbol = v.symbol[at]
                for i in np.flatnonzero(at < 0):
                    symbol[i] = VOCABULARY + tail_of(found[i])
                there = at >= 0
                tail = Counter([found[i] for i in np.flatnonzero(~there)])
                words += tail
                times += tail.values()
                sizes.append(len(tail))
                logs = np.where(there, v.log_count[at], 0)
                in_tail = symbol >= VOCABULARY
                symbols.append(symbol.astype(np.int16))
                known.append(int((there & (v.counts[at] > 0)).sum()) if len(v.counts) else 0)
                counted.append(logs.sum() / np.log(10))
                modelled.append((logs[in_tail].sum() - v.norm[symbol[in_tail] - VOCABULARY].sum()) / np.log(10))
            modelled = np.array(modelled) + run(model, symbols) / np.log(10)
            tail = pa.StructArray.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array(times, pa.int64())], ["word", "n"])
            tail = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), tail)
            yield pa.RecordBatch.from_arrays([b.column("uid"), b.column("doc_id"), pa.array([len(s) for s in symbols], pa.int64()), pa.array(known, pa.int64()), pa.array(counted, pa.float64()), pa.array(modelled, pa.float64()), tail], ["uid", "doc_id", "n_tokens", "n_known", "counted", "modelled", "tail"])

    rows = columns(docs, doc_id="long", text="string").select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text")
    found = saved(rows.mapInArrow(each, SCORED), "scored")
    tail = found.select("uid", F.explode("tail").alias("t")).select("uid", "t.word", F.col("t.n").alias("times"))
    joined = tail.join(counts, "word", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rest = joined.groupBy("uid").agg(F.sum(F.col("times") * F.log10(F.col("n") + 0.5)).alias("rest"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more"))
    zero, part = F.lit(0.0), float(np.log10(held.total + 0.5 * (held.distinct + 1)))
    return found.drop("tail").join(rest, "uid", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(held.total).cast("long").alias("train_tokens"),
        (F.col("counted") + F.coalesce("rest", zero) - F.col("n_tokens") * part).alias("base_score"), (F.col("modelled") + F.coalesce("rest", zero)).alias("score"),
    )


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(fold(doc_id, 5) == 1, F.lit(False))
