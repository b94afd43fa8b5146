"""Products of many portfolios with one panel, by blocks.

Portfolios are dealt into chunks of one packed row each; a panel (returns by ticker and date, or a matrix by
ticker and ticker) is packed into tiles, and every chunk meets every tile as two bounded numpy blocks. So
holdings are shuffled once, never per date, and no join runs on the few tickers. A chunk holds at least
four portfolios a ticker: the copies of the tiles then stay below the size of what is computed from them.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.expr import TRADING_DAYS

CHUNK = 1024  # portfolios a chunk at least; rows of a dense block at most
TILE_CELLS = 4 << 20  # cells of a tile, about


def return_tiles(rets: DataFrame, tickers: Column) -> DataFrame:
    """(block, names, keys, values): the returns of up to 64 calendar days, fewer where tickers are many."""
    days = F.greatest(F.lit(1), F.least(F.lit(64), F.floor(F.lit(TILE_CELLS) / tickers))).cast("int")
    block = F.floor(F.datediff("date", F.lit("1970-01-01").cast("date")) / days).cast("int")
    cells = rets.groupBy(block.alias("block")).agg(F.collect_list(F.struct("ticker", "date", F.coalesce("ret", F.lit(float("nan"))).alias("ret"))).alias("_c"))
    return cells.select("block", F.col("_c.ticker").alias("names"), F.col("_c.date").alias("keys"), F.col("_c.ret").alias("values"))


def matrix_tiles(cov: DataFrame, tickers: Column) -> DataFrame:
    """(block, names, keys, values): columns j of a group of rows i; names are j, keys are i."""
    groups = F.greatest(F.ceil(tickers * tickers / F.lit(TILE_CELLS)), F.lit(1)).cast("int")
    cells = cov.groupBy(F.pmod(F.xxhash64("i"), groups).cast("int").alias("block")).agg(F.collect_list(F.struct("j", "i", F.coalesce("value", F.lit(0.0)).alias("value"))).alias("_c"))
    return cells.select("block", F.col("_c.j").alias("names"), F.col("_c.i").alias("keys"), F.col("_c.value").alias("values"))


def streamed(weights: DataFrame, tiles: DataFrame, tickers: Column, work, schema: str, chunk: Column | None = None) -> DataFrame:
    """Rows of ``work`` over every chunk of portfolios (of about ``chunk``); tiles reach a chunk in order of their block."""
    id_type, key_type = weights.schema["portfolio_id"].dataType, tiles.schema["keys"].dataType
    books = weights.groupBy("portfolio_id").agg(F.collect_list(F.struct("ticker", F.coalesce("weight", F.lit(0.0)).alias("weight"))).alias("_h"))
    chunks = weights.agg(F.greatest(F.ceil(F.count_distinct("portfolio_id") / (F.greatest(F.lit(CHUNK), tickers * 4) if chunk is None else chunk)), F.lit(1)).cast("int")).scalar()
    heads = books.select(F.pmod(F.xxhash64("portfolio_id"), chunks).cast("int").alias("chunk"), F.lit(0).alias("kind"), F.lit(0).alias("block"), "portfolio_id",
                         F.col("_h.ticker").alias("names"), F.lit(None).cast(key_type).alias("keys"), F.col("_h.weight").alias("values"))
    body = tiles.select(F.explode(F.sequence(F.lit(0), chunks - 1)).alias("chunk"), F.lit(1).alias("kind"), "block", F.lit(None).cast(id_type).alias("portfolio_id"), "names", "keys", "values")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, job = None, [], None
        for batch in batches:
            chunk, kind = batch.column("chunk").to_pylist(), batch.column("kind").to_pylist()
            ids, names, keys, values = (batch.column(c) for c in ("portfolio_id", "names", "keys", "values"))
            for r in range(batch.num_rows):
                if chunk[r] != now:
                    if job is not None:
                        yield from job.end()
                    now, held, job = chunk[r], [], None
                if kind[r] == 0:
                    held.append((ids[r].as_py(), names[r].values, values[r].values))
                elif held or job is not None:
                    job = job or work(Books(held, ids.type))
                    held = []
                    yield from job.tile(names[r].values, keys[r].values, values[r].values)
        if job is not None:
            yield from job.end()

    return heads.unionByName(body).repartition("chunk").sortWithinPartitions("chunk", "kind", "block").mapInArrow(task, schema)


class Books:
    """The portfolios of a chunk: flat holdings in order of the portfolios."""

    def __init__(self, held: list, id_type: pa.DataType):
        self.ids = pa.array([h[0] for h in held], id_type)
        self.starts = np.cumsum([0, *(len(h[1]) for h in held)])
        names = pa.concat_arrays([h[1] for h in held]).dictionary_encode()
        self.names, self.codes = names.dictionary, names.indices.to_numpy(zero_copy_only=False)
        self.weights = pa.concat_arrays([h[2] for h in held]).to_numpy(zero_copy_only=False)
        self.rows = np.repeat(np.arange(len(held)), np.diff(self.starts))

    def columns(self, names: pa.Array) -> np.ndarray:
        """Position of each holding's ticker among ``names``; -1 where it is absent."""
        return pc.fill_null(pc.index_in(self.names, value_set=names), -1).to_numpy(zero_copy_only=False)[self.codes]

    def dense(self, columns: np.ndarray, width: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first, last, weights, holdings) of blocks of portfolios as dense matrices over the tile's tickers."""
        for lo in range(0, len(self.ids), CHUNK):
            hi = min(lo + CHUNK, len(self.ids))
            at = slice(self.starts[lo], self.starts[hi])
            there = columns[at] >= 0
            cell = (self.rows[at][there] - lo, columns[at][there])
            w, k = np.zeros((hi - lo, width)), np.zeros((hi - lo, width))
            np.add.at(w, cell, self.weights[at][there])
            np.add.at(k, cell, 1.0)
            yield lo, hi, w, k


def grid(names: pa.Array, keys: pa.Array, values: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray, np.ndarray]:
    """(names, keys in order, matrix names x keys with 0 for missing, mask of cells: 1 value, 2 null, 0 absent)."""
    n = names.dictionary_encode()
    ordered = pc.unique(keys).take(pc.sort_indices(pc.unique(keys)))
    at = (n.indices.to_numpy(zero_copy_only=False), pc.index_in(keys, value_set=ordered).to_numpy(zero_copy_only=False))
    v = values.to_numpy(zero_copy_only=False)
    x, mask = np.zeros((len(n.dictionary), len(ordered))), np.zeros((len(n.dictionary), len(ordered)), np.int8)
    good = np.isfinite(v)
    x[at] = np.where(good, v, 0.0)
    mask[at] = np.where(good, 1, 2)
    return n.dictionary, ordered, x, mask


class Sums:
    """(portfolio_id, date, ret, held, n): weighted sum, weight and number of the holdings with a return that day; ret is null where none has one."""

    def __init__(self, books: Books):
        self.books = books

    def tile(self, names: pa.Array, keys: pa.Array, values: pa.Array) -> Iterator[pa.RecordBatch]:
        names, days, x, mask = grid(names, keys, values)
        there, listed = (mask == 1).astype(float), (mask > 0).astype(float)
        for lo, hi, w, k in self.books.dense(self.books.columns(names), len(names)):
            n = k @ there
            i, j = np.nonzero(k @ listed)
            ret = pa.array((w @ x)[i, j], mask=n[i, j] == 0)
            yield pa.RecordBatch.from_arrays([self.books.ids.slice(lo, hi - lo).take(pa.array(i)), days.take(pa.array(j)), ret, pa.array((w @ there)[i, j]), pa.array(n[i, j].astype(np.int64))],
                                             names=["portfolio_id", "date", "ret", "held", "n"])

    def end(self) -> Iterator[pa.RecordBatch]:
        return iter(())


class Facts:
    """Facts of each portfolio over its complete dates: the curve's ends, spread and worst fall, and the weighted volatility of its holdings.

    State: a few numbers a portfolio and two a holding, whatever the number of dates.
    """

    def __init__(self, books: Books):
        self.b, p = books, len(books.ids)
        self.need = np.diff(books.starts)
        self.n, self.sum, self.squares = np.zeros(p), np.zeros(p), np.zeros(p)
        self.value, self.first, self.peak, self.fall = np.ones(p), np.full(p, np.nan), np.zeros(p), np.full(p, np.nan)
        self.own, self.own_squares = np.zeros(len(books.codes)), np.zeros(len(books.codes))

    def tile(self, names: pa.Array, keys: pa.Array, values: pa.Array) -> Iterator[pa.RecordBatch]:
        names, _, x, mask = grid(names, keys, values)
        there = (mask == 1).astype(float)
        columns = self.b.columns(names)
        for lo, hi, w, k in self.b.dense(columns, len(names)):
            full = (k @ there) == self.need[lo:hi, None]
            r = np.where(full, w @ x, 0.0)
            self.n[lo:hi] += full.sum(1)
            self.sum[lo:hi] += r.sum(1)
            self.squares[lo:hi] += (r * r).sum(1)
            curve = np.cumprod(1 + r, axis=1) * self.value[lo:hi, None]
            seen = np.where(full, curve, -np.inf)
            some = full.any(1)
            new = some & np.isnan(self.first[lo:hi])
            self.first[lo:hi][new] = curve[new, full[new].argmax(1)]
            peak = np.maximum.accumulate(np.maximum(seen, np.where(self.n[lo:hi] > full.sum(1), self.peak[lo:hi], -np.inf)[:, None]), axis=1)
            with np.errstate(all="ignore"):
                fall = np.where(full & (peak != 0), curve / peak - 1, np.inf).min(1)
            low = np.fmin(self.fall[lo:hi], np.where(np.isfinite(fall), fall, np.nan))
            self.fall[lo:hi], self.value[lo:hi] = low, curve[:, -1]
            self.peak[lo:hi] = np.where(some, peak[:, -1], self.peak[lo:hi])
            at = slice(self.b.starts[lo], self.b.starts[hi])
            c, rows = columns[at], self.b.rows[at] - lo
            once = (c >= 0) & some[rows]
            f = full.astype(float)
            self.own[at][once] += (f @ x.T)[rows[once], c[once]]
            self.own_squares[at][once] += (f @ (x * x).T)[rows[once], c[once]]
        return iter(())

    def end(self) -> Iterator[pa.RecordBatch]:
        def spread(n: np.ndarray, s: np.ndarray, q: np.ndarray) -> np.ndarray:
            with np.errstate(all="ignore"):
                return np.where(n > 1, np.sqrt(np.maximum(q - s * s / n, 0) / (n - 1)), np.nan)

        vol = spread(self.n[self.b.rows], self.own, self.own_squares) * TRADING_DAYS ** 0.5
        weighted = np.bincount(self.b.rows, np.nan_to_num(self.b.weights * vol), minlength=len(self.n))
        some = self.n > 0
        out = [self.b.ids, pa.array(self.n.astype(np.int64))] + [pa.array(v, mask=~some | np.isnan(v)) for v in (
            self.first, self.value, spread(self.n, self.sum, self.squares), self.fall, np.where(self.n > 1, weighted, np.nan))]
        yield pa.RecordBatch.from_arrays(out, names=["portfolio_id", "n", "first_value", "final", "sd", "max_dd", "weighted_vol"]).filter(pa.array(some))


class Shares:
    """(portfolio_id, ticker, weight, share): weight times the matrix's product with the portfolio, for each holding the matrix has. State: one number a holding."""

    def __init__(self, books: Books):
        self.b, self.share = books, np.zeros(len(books.codes))
        self.known = np.zeros(len(books.codes), bool)

    def tile(self, names: pa.Array, keys: pa.Array, values: pa.Array) -> Iterator[pa.RecordBatch]:
        names, rows, x, _ = grid(names, keys, values)
        mine = self.b.columns(rows)
        for lo, hi, w, _ in self.b.dense(self.b.columns(names), len(names)):
            at = slice(self.b.starts[lo], self.b.starts[hi])
            c, of = mine[at], self.b.rows[at] - lo
            has = c >= 0
            self.share[at][has] = self.b.weights[at][has] * (w @ x)[of[has], c[has]]
            self.known[at] |= has
        return iter(())

    def end(self) -> Iterator[pa.RecordBatch]:
        total = np.bincount(self.b.rows, self.share, minlength=len(self.b.ids))[self.b.rows]
        k = self.known
        yield pa.RecordBatch.from_arrays([self.b.ids.take(pa.array(self.b.rows[k])), self.b.names.take(pa.array(self.b.codes[k])), pa.array(self.b.weights[k]), pa.array(self.share[k]), pa.array(total[k])],
                                         names=["portfolio_id", "ticker", "weight", "share", "variance"])


def scatter(a: np.ndarray, b: np.ndarray, seed: int) -> np.ndarray:
    """The draws of ``functions.expr.scatter``, in 64-bit arithmetic."""
    m = 4294967296
    x = (a * 2654435761 + b * 2246822519 + seed) % m
    for shift, factor in ((16, 569420461), (15, 1935289751)):
        x = ((x ^ (x >> shift)) * factor) % m
    return x ^ (x >> 15)


def bounded_shares(x: np.ndarray, lo: float, hi: float) -> np.ndarray:
    """Shares of each row's sizes that sum to one inside the bounds; equal ones where the bounds cannot hold.

    Sizes are sorted down: those at the high come first, and one is below it if its share of what they leave is.
    """
    n = x.shape[1]
    free = 1.0 - n * lo
    if n * hi < 1 or free < 0:
        return np.full(x.shape, 1.0 / n)
    order = np.argsort(-x, axis=1, kind="stable")
    size = np.take_along_axis(x, order, 1)
    rest = np.cumsum(size[:, ::-1], axis=1)[:, ::-1]
    at_high = (size * (free - np.arange(n) * (hi - lo)) > (hi - lo) * rest).sum(1, keepdims=True)
    below = np.arange(n) >= at_high
    left = np.where(below, size, 0.0).sum(1, keepdims=True)
    share = np.where(below, lo + size * (free - at_high * (hi - lo)) / np.where(left > 0, left, 1.0), hi)
    out = np.empty_like(share)
    np.put_along_axis(out, order, share, 1)
    return out


class Search:
    """Best of repeatable random portfolios a group: (portfolio_id, optimizer, sample, ticker, weight, ret, vol, sharpe).

    All samples of a group are one matrix; each tile of the covariance adds its part of their quadratic forms. The
    tile's key null holds expected returns, zero where missing. A holding without a matrix row adds nothing; a group of
    such holdings alone gives no rows. A holding's number among all tickers comes as its weight.
    """

    def __init__(self, books: Books, samples: int, rf: float, target: float, bounds: tuple[float, float], seed: int):
        self.b, self.rf, self.target = books, rf, target
        self.var, self.gain, self.known = np.zeros((len(books.ids), samples)), np.zeros(len(books.codes)), np.zeros(len(books.codes), bool)
        self.w = []
        for lo, hi in zip(books.starts[:-1], books.starts[1:], strict=True):
            order = np.argsort(books.weights[lo:hi], kind="stable")  # ties of size go by ticker
            x = (scatter(np.arange(samples)[:, None], books.weights[lo:hi][order].astype(np.int64)[None, :], seed) % 1000 + 1) / 1000.0
            w = np.empty(x.shape)
            w[:, order] = bounded_shares(x * x, *bounds)
            self.w.append(w)

    def tile(self, names: pa.Array, keys: pa.Array, values: pa.Array) -> Iterator[pa.RecordBatch]:
        names, rows, x, _ = grid(names, keys, values)
        gain = [i for i, r in enumerate(rows.to_pylist()) if r is None]
        columns, mine = self.b.columns(names), self.b.columns(rows)
        self.known |= mine >= 0
        if gain:
            self.gain[columns >= 0] = x[columns[columns >= 0], gain[0]]
        for g, (lo, hi) in enumerate(zip(self.b.starts[:-1], self.b.starts[1:], strict=True)):
            c, k = columns[lo:hi], mine[lo:hi]
            w = self.w[g][:, c >= 0]
            self.var[g] += ((w @ x[np.ix_(c[c >= 0], k[k >= 0])]) * self.w[g][:, k >= 0]).sum(1)
        return iter(())

    def end(self) -> Iterator[pa.RecordBatch]:
        vol, gain = np.sqrt(np.maximum(self.var, 0.0)), np.where(self.known, self.gain, 0.0)
        ret = np.array([w @ gain[lo:hi] for w, lo, hi in zip(self.w, self.b.starts[:-1], self.b.starts[1:], strict=True)])
        some = np.bincount(self.b.rows, self.known, minlength=len(self.b.ids))[self.b.rows] > 0
        with np.errstate(all="ignore"):
            sharpe = np.where(vol > 0, (ret - self.rf) / vol, np.nan)
        best = {"min_var": vol.argmin(1), "max_sharpe": np.where(np.isnan(sharpe), -np.inf, sharpe).argmax(1),
                "efficient_risk": np.where(vol <= self.target, ret, -vol - 1000).argmax(1)}
        for name, at in best.items():
            row = self.b.rows
            pick = at[row]
            s = sharpe[row, pick]
            yield pa.RecordBatch.from_arrays([
                self.b.ids.take(pa.array(row)), pa.array([name] * len(row)), pa.array(pick.astype(np.int64)), self.b.names.take(pa.array(self.b.codes)),
                pa.array(np.concatenate([w[i] for w, i in zip(self.w, at, strict=True)])), pa.array(ret[row, pick]), pa.array(vol[row, pick]), pa.array(s, mask=np.isnan(s))],
                names=["portfolio_id", "optimizer", "sample", "ticker", "weight", "ret", "vol", "sharpe"]).filter(pa.array(some))


def searched(holdings: DataFrame, cov: DataFrame, mu: DataFrame, samples: int, rf: float, target: float, bounds: tuple[float, float], seed: int) -> DataFrame:
    """``Search`` over holdings (portfolio_id, ticker, ord), a matrix (i, j, value) and expected returns (ticker, ann_return).

    A chunk's samples stay near 64 MB, at one group at least.
    """
    tickers = _tickers(cov, "i")
    both = cov.select("i", "j", "value").unionByName(mu.select(F.lit(None).cast("string").alias("i"), F.col("ticker").alias("j"), F.col("ann_return").alias("value")))
    chunk = F.greatest(F.lit(1), F.floor(F.lit(8 << 20) / (tickers * samples)))
    weights = holdings.select("portfolio_id", "ticker", F.col("ord").cast("double").alias("weight"))
    return streamed(weights, matrix_tiles(both, tickers), tickers, lambda books: Search(books, samples, rf, target, bounds, seed),
                    f"{_id(weights)}, optimizer string, sample long, ticker string, weight double, ret double, vol double, sharpe double", chunk)


def _id(weights: DataFrame) -> str:
    return f"portfolio_id {weights.schema['portfolio_id'].dataType.simpleString()}"


def _tickers(df: DataFrame, name: str = "ticker") -> Column:
    return df.agg(F.greatest(F.count_distinct(name), F.lit(1))).scalar()


def daily_sums(weights: DataFrame, rets: DataFrame) -> DataFrame:
    """``Sums`` of every portfolio and date on which it has a row of the panel."""
    n = _tickers(rets)
    return streamed(weights, return_tiles(rets, n), n, Sums, f"{_id(weights)}, date date, ret double, held double, n long")


def complete_facts(weights: DataFrame, rets: DataFrame) -> DataFrame:
    """``Facts`` of every portfolio with a complete date."""
    n = _tickers(rets)
    return streamed(weights, return_tiles(rets, n), n, Facts, f"{_id(weights)}, n long, first_value double, final double, sd double, max_dd double, weighted_vol double")


def matrix_shares(weights: DataFrame, cov: DataFrame) -> DataFrame:
    """``Shares`` of every holding, with their sum a portfolio, for a matrix in long form (i, j, value)."""
    n = _tickers(cov, "i")
    return streamed(weights, matrix_tiles(cov, n), n, Shares, f"{_id(weights)}, ticker string, weight double, share double, variance double")
