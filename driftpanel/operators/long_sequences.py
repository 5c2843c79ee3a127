"""Hidden Markov inference on sequences of any length: chunks in several tasks, joined by an associative scan.

A chunk of steps is a matrix: entry (i, j) is the log weight of all paths (or of the best path) from state i before
the chunk to state j at its end. Matrices multiply associatively, so what arrives at each chunk follows
from products of groups of chunks, groups of groups, and so on. With what arrives a chunk is decoded alone.
No task holds more than one chunk or one group of matrices at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from driftpanel.functions.lineage import cut_lineage
from driftpanel.operators.hmm import HmmModel, _by_length, _log, _logsum, log_density, unpack

CHUNK = 4096
#: Matrices that one task multiplies one after another.
FAN = 256


@dataclass(frozen=True)
class _Scan:
    """How two neighbours combine (the earlier one first) and how what arrives passes over one of them."""

    product: Callable[[np.ndarray, np.ndarray], np.ndarray]
    carry: Callable[[np.ndarray, np.ndarray], np.ndarray]
    reverse: bool = False


def _times(a: np.ndarray, b: np.ndarray, best: bool) -> np.ndarray:
    """Product of log matrices (rows, k) and (k, columns), summed or maximised over k."""
    paths = a[:, :, None] + b[None]
    return paths.max(1) if best else _logsum(paths, axis=1)


def _forward_scan(k: int) -> _Scan:
    """All paths and best paths side by side: 2 K^2 numbers a chunk, 2 K numbers arrive."""
    split = lambda m: (m[: k * k].reshape(k, k), m[k * k :].reshape(k, k))

    def product(a, b):
        return np.concatenate([_times(x, y, best).ravel() for x, y, best in zip(split(a), split(b), (False, True))])

    def carry(v, m):
        return np.concatenate([_times(x[None], y, best)[0] for x, y, best in zip((v[:k], v[k:]), split(m), (False, True))])

    return _Scan(product, carry)


def _backward_scan(k: int) -> _Scan:
    """All paths from the end: what follows a chunk passes over it to what follows the one before."""

    def product(a, b):
        return _times(a[: k * k].reshape(k, k), b[: k * k].reshape(k, k), False).ravel()

    def carry(v, m):
        return _times(m[: k * k].reshape(k, k), v[:, None], False)[:, 0]

    return _Scan(product, carry, reverse=True)


#: The best state before a chunk for each state at its end; the end state passes backwards.
_TRACE = _Scan(lambda a, b: a[b.astype(int)], lambda v, m: m[v.astype(int)], reverse=True)


def _arrivals(matrices: DataFrame, initial: DataFrame, scan: _Scan, chunks: int, fan: int) -> DataFrame:
    """``subject_id, chunk, arrives`` from ``matrices(subject_id, chunk, m)`` and what arrives first, ``initial(subject_id, arrives)``."""
    levels = [matrices.select("subject_id", F.col("chunk").alias("place"), "m")]
    keyed = lambda df: df.withColumn("parent", F.expr(f"place div {fan}"))

    def whole(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ms = [np.asarray(m) for m in pdf.sort_values("place")["m"]]
        out = ms[0]
        for m in ms[1:]:
            out = scan.product(out, m)
        return pd.DataFrame({"subject_id": [key[0]], "place": [key[1]], "m": [out]})

    def through(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("place", ascending=not scan.reverse)
        at, out = np.asarray(rows["arrives"].iloc[0]), []
        for m in rows["m"]:
            out.append(at)
            at = scan.carry(at, np.asarray(m))
        return pd.DataFrame({"subject_id": rows["subject_id"].to_numpy(), "place": rows["place"].to_numpy(), "arrives": out})

    n = chunks
    while n > fan:
        grouped = keyed(levels[-1]).groupBy("subject_id", "parent")
        levels.append(cut_lineage(grouped.applyInPandas(whole, "subject_id string, place long, m array<double>")))
        n = -(-n // fan)
    known = initial.select("subject_id", F.lit(0).cast("long").alias("parent"), "arrives")
    for level in reversed(levels):
        grouped = keyed(level).join(known, ["subject_id", "parent"]).groupBy("subject_id", "parent")
        found = cut_lineage(grouped.applyInPandas(through, "subject_id string, place long, arrives array<double>"))
        known = found.withColumnRenamed("place", "parent")
    return known.withColumnRenamed("parent", "chunk")


def cut_sequences(rows: DataFrame, order: str = "t", values: str = "x", chunk: int = CHUNK) -> DataFrame:
    """``subject_id, chunk, xs`` from one row per step; steps of a subject are numbered 0, 1, 2, ... without gaps or repeats."""
    steps = rows.select(F.col("subject_id").cast("string").alias("subject_id"), F.col(order).cast("long").alias("t"), F.col(values).alias("x"))
    cut = steps.withColumn("chunk", F.expr(f"t div {chunk}")).groupBy("subject_id", "chunk")
    table = cut_lineage(cut.agg(F.sort_array(F.collect_list(F.struct("t", "x"))).alias("s")))
    first, last = F.get("s", F.lit(0))["t"], F.element_at("s", -1)["t"]
    table = table.withColumns({"first": first, "last": last, "n": F.size("s")})
    bad = (F.col("first") != F.col("chunk") * chunk) | (F.col("last") - F.col("first") + 1 != F.col("n"))
    ends = table.groupBy("subject_id").agg(F.count_if(bad).alias("bad"), F.sum("n").alias("n"), F.max("last").alias("last"), F.count_if(F.col("subject_id").isNull()).alias("unnamed"))
    if ends.where("bad > 0 OR n != last + 1 OR unnamed > 0").take(1):
        raise ValueError("steps of a subject must be numbered 0, 1, 2, ... once each, and subjects named")
    return table.select("subject_id", "chunk", F.transform("s", lambda e: e["x"]).alias("xs"))


def _entered(model: HmmModel, density: np.ndarray, is_first: np.ndarray) -> np.ndarray:
    """Log weights (n, K before, K) of the first step of each chunk for each state before it."""
    entry = np.where(is_first[:, None, None], _log(model.start)[None, None], _log(model.trans)[None])
    return entry + density[:, None, 0]


def _matrices(model: HmmModel):
    k = model.n_states

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_trans = _log(model.trans)
        for batch in batches:
            x, lengths = unpack(batch.column("xs"))
            first = batch.column("chunk").to_numpy() == 0
            density = log_density(x, model.means, model.covars)
            out = np.zeros((len(lengths), 2, k, k))
            for chosen, index in _by_length(lengths):
                b = density[index]
                every = best = _entered(model, b, first[chosen])
                for step in range(1, b.shape[1]):
                    every = _logsum(every[..., None] + log_trans, axis=2) + b[:, None, step]
                    best = (best[..., None] + log_trans).max(2) + b[:, None, step]
                out[chosen, 0], out[chosen, 1] = every, best
            m = pa.ListArray.from_arrays(pa.array(np.arange(len(lengths) + 1) * 2 * k * k, pa.int32()), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("subject_id"), batch.column("chunk"), m], ["subject_id", "chunk", "m"])

    return run


def _inner(model: HmmModel):
    """Chunks with what arrives and the state at their end to steps; the log likelihood of a chunk stands at its first step."""
    k = model.n_states

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_trans = _log(model.trans)
        for batch in batches:
            x, lengths = unpack(batch.column("xs"))
            total = len(x)
            first = batch.column("chunk").to_numpy() == 0
            arrives = np.asarray(batch.column("arrives").flatten()).reshape(-1, 2 * k)
            end = batch.column("end").to_numpy().astype(int)
            density = log_density(x, model.means, model.covars)
            state, belief, gained = np.zeros(total, np.int32), np.zeros((total, k)), np.zeros(total)
            for chosen, index in _by_length(lengths):
                b, rows = density[index], np.arange(len(chosen))
                entered = _entered(model, b, first[chosen])
                message = _logsum(arrives[chosen, :k, None] + entered, axis=1)
                best = (arrives[chosen, k:, None] + entered).max(1)
                back = np.zeros(b.shape, np.int32)
                for step in range(b.shape[1]):
                    if step:
                        message = _logsum(message[:, :, None] + log_trans, axis=1) + b[:, step]
                        options = best[:, :, None] + log_trans
                        back[:, step] = options.argmax(1)
                        best = options.max(1) + b[:, step]
                    level = _logsum(message, axis=1)
                    belief[index[:, step]] = np.exp(message - level[:, None])
                gained[index[:, 0]] = level - _logsum(arrives[chosen, :k], axis=1)
                at = end[chosen]
                for step in range(b.shape[1] - 1, -1, -1):
                    state[index[:, step]] = at
                    at = back[rows, step, at]
            starts = np.cumsum(lengths) - lengths
            inside = np.arange(total) - np.repeat(starts, lengths)
            posterior = pa.ListArray.from_arrays(pa.array(np.arange(total + 1) * k, pa.int32()), pa.array(belief.ravel()))
            owner = pa.array(np.repeat(np.arange(len(lengths)), lengths))
            columns = [batch.column("subject_id").take(owner), pa.array(np.repeat(batch.column("chunk").to_numpy(), lengths)), pa.array(inside), pa.array(state), posterior, pa.array(gained)]
            yield pa.RecordBatch.from_arrays(columns, ["subject_id", "chunk", "inside", "state", "posterior", "gained"])

    return run


def _last_chunks(table: DataFrame) -> tuple[DataFrame, int]:
    last = table.groupBy("subject_id").agg(F.max("chunk").alias("chunk"))
    return last, (last.agg(F.max("chunk")).first()[0] or 0) + 1


def infer_steps(rows: DataFrame, model: HmmModel, order: str = "t", values: str = "x", chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """``subject_id, t, state, posterior, gained`` of every step: Viterbi path and causal posterior of each sequence.

    The sum of ``gained`` over a subject is its log likelihood. Sequences may have any length: memory per
    task is a few chunks, and the number of rounds grows with the logarithm of the number of chunks. No rows give no rows.
    """
    k = model.n_states
    table = cut_sequences(rows, order, values, chunk)
    last, chunks = _last_chunks(table)
    matrices = cut_lineage(table.mapInArrow(_matrices(model), "subject_id string, chunk long, m array<double>"))
    nothing = [0.0] + [float("-inf")] * (k - 1)
    begin = last.select("subject_id", F.array(*[F.lit(v) for v in nothing * 2]).alias("arrives"))
    arrived = _arrivals(matrices, begin, _forward_scan(k), chunks, fan)

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.asarray(batch.column("arrives").flatten()).reshape(-1, 2, k)[:, 1]
            options = v[:, :, None] + np.asarray(batch.column("m").flatten()).reshape(-1, 2, k, k)[:, 1]
            m = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * k, pa.int32()), pa.array(options.argmax(1).astype(float).ravel()))
            end = pa.array(options.max(1).argmax(1).astype(float))
            yield pa.RecordBatch.from_arrays([batch.column("subject_id"), batch.column("chunk"), m, end], ["subject_id", "chunk", "m", "end"])

    both = arrived.join(matrices, ["subject_id", "chunk"])
    traces = cut_lineage(both.mapInArrow(traced, "subject_id string, chunk long, m array<double>, end double"))
    final = traces.join(last, ["subject_id", "chunk"]).select("subject_id", F.array("end").alias("arrives"))
    ends = _arrivals(traces.select("subject_id", "chunk", "m"), final, _TRACE, chunks, fan).select("subject_id", "chunk", F.get("arrives", F.lit(0)).alias("end"))
    ready = table.join(arrived, ["subject_id", "chunk"]).join(ends, ["subject_id", "chunk"])
    steps = ready.mapInArrow(_inner(model), "subject_id string, chunk long, inside long, state int, posterior array<double>, gained double")
    return steps.select("subject_id", (F.col("chunk") * chunk + F.col("inside")).alias("t"), "state", "posterior", "gained")


def expected_counts(rows: DataFrame, model: HmmModel, order: str = "t", values: str = "x", chunk: int = CHUNK, fan: int = FAN) -> dict[str, np.ndarray]:
    """Sums of one expectation pass over all sequences: ``ll, start (K), trans (K, K), weight (K), first (K, D), second (K, D)``.

    Moments are centred on the model's means. A chunk gets what arrives from both sides, and
    returns one row of sums; their size depends on the model only.
    """
    k, d = model.means.shape
    table = cut_sequences(rows, order, values, chunk)
    last, chunks = _last_chunks(table)
    matrices = cut_lineage(table.mapInArrow(_matrices(model), "subject_id string, chunk long, m array<double>"))
    nothing = [0.0] + [float("-inf")] * (k - 1)
    begin = last.select("subject_id", F.array(*[F.lit(v) for v in nothing * 2]).alias("arrives"))
    before = _arrivals(matrices, begin, _forward_scan(k), chunks, fan)
    finish = last.select("subject_id", F.array_repeat(F.lit(0.0), k).alias("arrives"))
    after = _arrivals(matrices, finish, _backward_scan(k), chunks, fan).withColumnRenamed("arrives", "follows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_trans = _log(model.trans)
        sums = np.zeros(1 + k + k * k + k + 2 * k * d)
        for batch in batches:
            x, lengths = unpack(batch.column("xs"))
            first = batch.column("chunk").to_numpy() == 0
            arrives = np.asarray(batch.column("arrives").flatten()).reshape(-1, 2 * k)[:, :k]
            follows = np.asarray(batch.column("follows").flatten()).reshape(-1, k)
            density = log_density(x, model.means, model.covars)
            for chosen, index in _by_length(lengths):
                b, length = density[index], index.shape[1]
                entered = _entered(model, b, first[chosen])
                alpha = np.empty_like(b)
                alpha[:, 0] = _logsum(arrives[chosen, :, None] + entered, axis=1)
                for step in range(1, length):
                    alpha[:, step] = _logsum(alpha[:, step - 1, :, None] + log_trans, axis=1) + b[:, step]
                beta = follows[chosen]
                whole = _logsum(alpha[:, -1] + beta, axis=1)
                ll = (_logsum(alpha[:, -1], axis=1) - _logsum(arrives[chosen], axis=1)).sum()
                start, trans, weight = np.zeros(k), np.zeros((k, k)), np.zeros(k)
                one, two = np.zeros((k, d)), np.zeros((k, d))
                for step in range(length - 1, -1, -1):
                    gamma = np.exp(alpha[:, step] + beta - whole[:, None])
                    delta = x[index[:, step]][:, None, :] - model.means
                    weight += gamma.sum(0)
                    one += np.einsum("nk,nkd->kd", gamma, delta)
                    two += np.einsum("nk,nkd->kd", gamma, delta**2)
                    if step:
                        trans += np.exp(alpha[:, step - 1, :, None] + log_trans + (b[:, step] + beta - whole[:, None])[:, None]).sum(0)
                        beta = _logsum(log_trans + (b[:, step] + beta)[:, None], axis=2)
                    else:
                        start += gamma[first[chosen]].sum(0)
                        later = ~first[chosen]
                        trans += np.exp(arrives[chosen][later, :, None] + entered[later] + (beta - whole[:, None])[later][:, None]).sum(0)
                sums += np.concatenate([[ll], start, trans.ravel(), weight, one.ravel(), two.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([sums.tolist()], pa.list_(pa.float64()))], ["s"])

    ready = table.join(before, ["subject_id", "chunk"]).join(after, ["subject_id", "chunk"])
    parts = ready.mapInArrow(run, "s array<double>").select(F.posexplode("s").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"))
    flat = np.zeros(1 + k + k * k + k + 2 * k * d)
    for row in parts.collect():
        flat[row.i] = row.v
    cuts = np.split(flat, np.cumsum([1, k, k * k, k, k * d]))
    shapes = {"ll": (), "start": (k,), "trans": (k, k), "weight": (k,), "first": (k, d), "second": (k, d)}
    return {name: part.reshape(shape) for (name, shape), part in zip(shapes.items(), cuts, strict=True)}
