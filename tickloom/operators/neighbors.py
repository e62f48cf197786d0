"""Exact nearest neighbours and what they say: outcome spread, state and action values.

The index prunes with pivots (reference points taken from the index). Every index vector
belongs to the cell of its nearest pivot. The distance of a query to its k-th nearest
eligible pivot already bounds its k-th neighbour, because pivots are index members, so only
cells that can hold something closer are visited. Small cells share a bin, and a cell above
the block size is cut into blocks, so a cell full of copies is many units of work; each unit
returns at most k rows per query. Nothing is dropped: the result equals brute force.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.functions import vocab as V
from tickloom.operators.ordered import hash_order, join_on, quantiles
from tickloom.session import scratch

PIVOTS = 64
BLOCK_ROWS = 20_000
STRIPE = 4  # blocks of a unit of work
LEAST_QUERIES = 1_000  # of a unit, unless there are fewer
MOST_TASKS = 4_000
TILE = (256, 4096)  # queries and rows compared at a time


def unit(vector: Column) -> Column:
    """Vector scaled to length 1 (a zero vector stays)."""
    v = F.transform(vector, lambda x: x.cast("double"))
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    # the length goes through a struct, so that it is taken once and not again for every element
    one = F.array(F.struct(v.alias("v"), F.greatest(size, F.lit(1e-12)).alias("size")))
    return F.get(F.transform(one, lambda p: F.transform(p["v"], lambda x: x / p["size"])), 0)


def pack_cells(sizes: dict[int, int], block_rows: int) -> tuple[dict[int, int], list[int]]:
    """(bin of each cell, blocks of each bin): small cells together, a large one alone in several blocks."""
    bins, blocks, open_rows = {}, [], None
    for cell, n in sorted(sizes.items()):
        if n > block_rows:
            bins[cell] = len(blocks)
            blocks.append(-(-n // block_rows))
        else:
            if open_rows is None or open_rows[1] + n > block_rows:
                open_rows = [len(blocks), 0]
                blocks.append(1)
            bins[cell] = open_rows[0]
            open_rows[1] += n
    return bins, blocks


@dataclass(frozen=True)
class NeighbourIndex:
    """A stored inverted-file index.

    ``pivots``   the reference points (a sample of the first rows, by a hash of the id);
    ``rows``     the vectors, partitioned by bin and sorted by block within it;
    ``cells``    per write and cell: its bin, first block, blocks, rows and the least and greatest distance
                 to its pivot. An append adds rows in blocks of their own and lines here; nothing is rebuilt.
    """

    spark: SparkSession
    path: str
    metric: str
    payload: tuple[str, ...]
    block_rows: int

    @classmethod
    def build(cls, index: DataFrame, path: str, metric: str = "l2", mask: str | None = None, payload: Sequence[str] = (), pivots: int = PIVOTS, block_rows: int = BLOCK_ROWS) -> NeighbourIndex:
        """Writes an index of ``id, vector`` (with ``mask`` and ``payload``) to a new folder."""
        made = cls(index.sparkSession, path, metric, tuple(payload), block_rows)
        base = made._prepared(index, mask, payload)
        first = index.orderBy(hash_order(F.col("id").cast("long")), F.col("id").cast("long")).limit(pivots)
        made._prepared(first, mask).coalesce(1).write.parquet(f"{path}/pivots")
        made._write(base)
        return made

    def append(self, index: DataFrame, mask: str | None = None) -> None:
        """Adds rows. Their distances to the pivots widen the cells' ranges; the pivots stay."""
        self._write(self._prepared(index, mask, self.payload))

    def _prepared(self, df: DataFrame, mask: str | None, extra: Sequence[str] = ()) -> DataFrame:
        v = unit(F.col("vector")) if self.metric == "cosine" else F.transform("vector", lambda x: x.cast("double"))
        m = F.col(mask).cast("string") if mask else F.lit(None).cast("string")
        return df.select(F.col("id").cast("long").alias("id"), v.alias("vec"), m.alias("m"), *extra)

    def _pivots(self):
        import numpy as np

        sample = self.spark.read.parquet(f"{self.path}/pivots").orderBy("id").collect()  # at most `pivots` rows
        return np.array([r["vec"] for r in sample]), np.array([r["m"] for r in sample], dtype=object)

    def cells(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/cells")

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def _write(self, base: DataFrame) -> None:
        from pyspark.sql.utils import AnalysisException

        centres, _ = self._pivots()

        def assign(batches):
            for pdf in batches:
                if len(pdf):
                    d = to_pivots(pdf["vec"], centres)
                    pdf["cell"] = d.argmin(1).astype("int32")
                    pdf["r"] = d.min(1)
                    yield pdf

        fields = ", ".join(f"`{n}` {t}" for n, t in base.dtypes)
        staged = scratch(self.spark, "cells")
        base.mapInPandas(assign, f"{fields}, cell int, r double").write.parquet(staged)
        celled = self.spark.read.schema(f"{fields}, cell int, r double").parquet(staged)
        stats = {r["cell"]: r for r in celled.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("lo"), F.max("r").alias("hi")).collect()}
        try:
            old = [r.asDict() for r in self.cells().collect()]  # a row per write and cell
        except AnalysisException:
            old = []
        bins, blocks = pack_cells({c: r["n"] for c, r in stats.items()}, self.block_rows)
        if old:  # a cell keeps its bin; new blocks come after the old ones
            of = {r["cell"]: r["bin"] for r in old}
            used = {}
            for r in old:
                used[r["bin"]] = max(used.get(r["bin"], 0), r["first_block"] + r["blocks"])
            fresh = max(used) + 1
            homes = {c: of.get(c, fresh + bins[c]) for c in bins}
            size: dict[int, int] = {}
            for c, b in homes.items():
                size[b] = size.get(b, 0) + stats[c]["n"]
            first = {b: used.get(b, 0) for b in size}
            count = {b: -(-n // self.block_rows) for b, n in size.items()}
        else:
            homes, first, count = bins, {b: 0 for b in range(len(blocks))}, dict(enumerate(blocks))
        at = F.col("cell") + 1
        widest = len(centres)

        def per_cell(values: dict[int, int]) -> Column:
            return F.element_at(F.array(*[F.lit(int(values.get(c, 0))) for c in range(max(widest, 1))]), at)

        block = per_cell({c: first[b] for c, b in homes.items()}) + F.pmod(F.xxhash64("id"), per_cell({c: count[b] for c, b in homes.items()}))
        placed = celled.withColumns({"bin": per_cell(homes), "block": block.cast("int")})
        placed.repartition("bin", "block").sortWithinPartitions("bin", "block", "id").write.mode("append").partitionBy("bin").parquet(f"{self.path}/rows")
        lines = [(c, homes[c], first[homes[c]], count[homes[c]], r["n"], r["lo"], r["hi"]) for c, r in sorted(stats.items())]
        text = ", ".join(f"({c}, {b}, {f}, {n}, {m}L, CAST('{lo!r}' AS DOUBLE), CAST('{hi!r}' AS DOUBLE))" for c, b, f, n, m, lo, hi in lines)
        if lines:
            self.spark.sql(f"SELECT * FROM VALUES {text} AS cells(cell, bin, first_block, blocks, n, lo, hi)").coalesce(1).write.mode("append").parquet(f"{self.path}/cells")

    def visits(self, queries: DataFrame, k: int, mask: str | None = None) -> DataFrame:
        """``id, vec, m, bin, block`` for every block that can hold one of a query's ``k`` nearest rows."""
        at = F.explode("blocks").alias("b")
        return self._visits(queries, k, mask).select("id", "vec", "m", at).select("id", "vec", "m", F.col("b.bin").alias("bin"), F.col("b.block").alias("block"))

    def _visits(self, queries: DataFrame, k: int, mask: str | None = None) -> DataFrame:
        """The queries with the array ``blocks`` of (bin, block, at), ``at`` numbering the blocks of all bins."""
        import numpy as np

        centres, owners = self._pivots()
        lines = self.cells().collect()
        at = sorted({r["cell"] for r in lines})
        lows = np.array([min(r["lo"] for r in lines if r["cell"] == c) for c in at])
        highs = np.array([max(r["hi"] for r in lines if r["cell"] == c) for c in at])
        bin_of = {r["cell"]: r["bin"] for r in lines}
        bins = sorted(set(bin_of.values()))
        bin_at = np.array([bin_of[c] for c in at], dtype=int)
        n_blocks = np.array([max(r["first_block"] + r["blocks"] for r in lines if r["bin"] == b) for b in bins], dtype=int)
        first = np.cumsum(n_blocks) - n_blocks
        bins = np.array(bins, dtype=int)
        apart = np.sqrt(((centres[:, None, :] - centres[None, :, :]) ** 2).sum(2))
        at = np.array(at, dtype=int)

        def visit(batches):
            for pdf in batches:
                if not len(pdf):
                    continue
                d = to_pivots(pdf["vec"], centres)
                eligible = np.where(owners[None, :] == pdf["m"].to_numpy(dtype=object)[:, None], np.inf, d) if mask else d
                bound = np.partition(eligible, k - 1, axis=1)[:, k - 1] if eligible.shape[1] >= k else np.full(len(pdf), np.inf)
                mine = d.argmin(1)
                near = d[:, at]
                low = np.maximum(np.maximum(near - highs, lows - near), 0)
                with np.errstate(divide="ignore", invalid="ignore"):
                    plane = (near**2 - d.min(1)[:, None] ** 2) / (2 * apart[mine][:, at])
                low = np.maximum(low, np.where(np.isfinite(plane), plane, 0))
                wanted_cells = low <= bound[:, None] * (1 + 1e-9) + 1e-9
                hits = np.stack([wanted_cells[:, bin_at == b].any(1) for b in bins], axis=1)
                pdf["bins"] = [np.flatnonzero(h).astype("int32") for h in hits]
                yield pdf

        found = self._prepared(queries, mask).mapInPandas(visit, "id long, vec array<double>, m string, bins array<int>")

        def blocks_of(i: Column) -> Column:
            of = F.array(*[F.struct(F.lit(int(b)).alias("bin"), F.lit(int(n)).alias("n"), F.lit(int(f)).alias("first")) for b, n, f in zip(bins, n_blocks, first)])
            one = F.get(of, i)
            return F.transform(F.sequence(F.lit(0), one["n"] - 1), lambda j: F.struct(one["bin"].alias("bin"), j.alias("block"), (one["first"] + j).alias("at")))

        return found.select("id", "vec", "m", F.flatten(F.transform("bins", blocks_of)).alias("blocks"))

    def search(self, queries: DataFrame, k: int, mask: str | None = None) -> DataFrame:
        """The ``k`` nearest rows of every query; see ``knn``. ``mask`` names the queries' column.

        Only the bins that some query visits are read. A unit of work is a part of the queries and a
        stripe of ``STRIPE`` blocks; it receives those blocks that one of its queries visits and gives a row
        per query with the nearest ``k`` of the stripe.
        """
        payload = list(self.payload)
        kinds = dict(self.rows().dtypes) if self.cells_known() else {p: "string" for p in payload}
        item = "distance double, id long" + "".join(f", `{p}` {kinds[p]}" for p in payload)
        columns = ["qid", "id", *payload, "distance", "rank"]
        if not self.cells_known():
            return self.spark.createDataFrame([], f"qid long, {item}, rank int").select(*columns)
        folder = scratch(self.spark, "visits")
        self._visits(queries, k, mask).write.parquet(folder)
        asked = self.spark.read.parquet(folder)
        n_queries = asked.count()
        block = F.explode("blocks").alias("b")
        known = [r["b"] for r in asked.select(block).distinct().collect()]  # the blocks that are visited
        stripes = max((b["at"] for b in known), default=0) // STRIPE + 1
        cores = self.spark.sparkContext.defaultParallelism
        # as many parts as bound the queries of a unit, more where the cores would lie idle
        parts = max(1, -(-n_queries // self.block_rows), min(-(-2 * cores // stripes), -(-n_queries // LEAST_QUERIES)))
        asked = asked.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
        where = asked.select(block, "part").distinct().select("b.*", "part")  # at most blocks x parts rows
        unit_of = (F.floor(F.col("at") / STRIPE) * parts + F.col("part")).cast("long").alias("unit")
        stored = self.rows().filter(F.col("bin").isin(sorted({b["bin"] for b in known})))
        stored = stored.join(F.broadcast(where), ["bin", "block"]).select(unit_of, "id", "vec", "m", "at", *payload)
        in_stripe = F.transform("blocks", lambda b: b["at"])
        mine = F.explode(F.array_distinct(F.transform(in_stripe, lambda b: F.floor(b / STRIPE)))).alias("stripe")
        dealt = asked.select("id", "vec", "m", "part", in_stripe.alias("blocks"), mine)
        dealt = dealt.select(
            (F.col("stripe") * parts + F.col("part")).cast("long").alias("unit"), "id", "vec", "m",
            F.filter("blocks", lambda b: F.floor(b / STRIPE) == F.col("stripe")).alias("blocks"),
        )

        def nearest(qs, xs):
            return nearest_of(qs, xs, k, bool(mask), payload)

        tasks = min(4 * stripes * parts, MOST_TASKS)
        units = dealt.repartition(tasks, "unit").groupBy("unit").cogroup(stored.repartition(tasks, "unit").groupBy("unit"))
        local = units.applyInArrow(nearest, f"qid long, near array<struct<{item}>>")
        merged = local.groupBy("qid").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
        return merged.select("qid", F.posexplode("near").alias("rank", "x")).select("qid", "x.*", (F.col("rank") + 1).alias("rank")).select(*columns)

    def cells_known(self) -> bool:
        """Whether anything has been written yet."""
        from pyspark.sql.utils import AnalysisException

        try:
            return not self.cells().isEmpty()
        except AnalysisException:
            return False


def to_pivots(vecs, centres):
    """Distances of a column of vectors to all pivots."""
    import numpy as np

    a = np.stack(vecs.to_numpy())
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (centres * centres).sum(1)[None, :] - 2 * a @ centres.T, 0))


def matrix(vectors):
    """The vectors of an Arrow list column as the rows of a matrix."""
    import numpy as np
    import pyarrow as pa

    whole = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    if whole.null_count:
        raise ValueError("a vector is null")
    return np.asarray(whole.flatten()).reshape(len(whole), -1)


def nearest_of(qs, xs, k: int, masked: bool, payload: Sequence[str]):
    """One unit of work: Arrow tables of queries and stored rows in, ``qid, near`` out, nearest first and ties by id.

    Blocks are met one after another in tiles, in ascending id. A tile keeps what is closer than
    a query's k-th so far, so after the first tiles little is left to sort.
    """
    import numpy as np
    import pyarrow as pa

    nq = qs.num_rows
    empty = np.zeros(0, dtype=np.int64)
    row, dist, place = empty, np.zeros(0), empty  # the nearest so far, by row, distance and id
    xs = xs.take(np.argsort(xs["id"].to_numpy(), kind="stable"))
    ids, at = xs["id"].to_numpy(), xs["at"].to_numpy()
    if nq and len(ids):
        a, b = matrix(qs["vec"]), matrix(xs["vec"])
        aa, bb = (a * a).sum(1), (b * b).sum(1)
        if masked:  # equal codes for equal values, null among them
            codes = pa.concat_arrays([c for t in (qs, xs) for c in t["m"].chunks]).fill_null("").dictionary_encode().indices.to_numpy()
            nulls = np.concatenate([np.asarray(t["m"].is_null()) for t in (qs, xs)])
            codes = np.where(nulls, -1, codes)
            q_code, x_code = codes[:nq], codes[nq:]
        wanted = qs["blocks"].combine_chunks()
        owner = np.repeat(np.arange(nq), np.asarray(wanted.value_lengths()))
        asked = np.asarray(wanted.flatten())
        for block in np.unique(at):
            cols, rows = np.flatnonzero(at == block), np.unique(owner[asked == block])
            for start in range(0, len(rows), TILE[0]):
                mine = rows[start : start + TILE[0]]
                bound = kth(row, dist, mine, k)
                limit = np.nextafter(bound, np.inf)  # equally near rows of other blocks may have smaller ids
                r, d, p = empty, np.zeros(0), empty  # of this block
                for left in range(0, len(cols), TILE[1]):
                    here = cols[left : left + TILE[1]]
                    # the sums of squares meet the products in place
                    near = a[mine] @ b[here].T
                    near *= -2
                    near += bb[here]
                    near += aa[mine][:, None]
                    np.maximum(near, 0, out=near)
                    hit = near < limit[:, None]
                    if np.count_nonzero(hit) > 4 * k * len(mine) and len(here) > k:
                        if masked:
                            near[q_code[mine][:, None] == x_code[here][None, :]] = np.inf
                        top = np.partition(near, k - 1, axis=1)[:, k - 1 : k]
                        less, same = near < top, near == top
                        hit &= less | (same & (np.cumsum(same, axis=1) <= k - less.sum(1, keepdims=True)))
                    i, j = np.divmod(np.flatnonzero(hit), len(here))
                    got = near[i, j]
                    keep = np.isfinite(got)
                    if masked:
                        keep &= q_code[mine[i]] != x_code[here[j]]
                    i, got, j = i[keep], got[keep], here[j[keep]]
                    if len(i):
                        r, d, p = first_k(np.concatenate([r, i]), np.concatenate([d, got]), np.concatenate([p, j]), k)
                        limit = np.minimum(limit, kth(r, d, np.arange(len(mine)), k))
                row, dist, place = np.concatenate([row, mine[r]]), np.concatenate([dist, d]), np.concatenate([place, p])
            row, dist, place = first_k(row, dist, place, k)
    counts = np.bincount(row, minlength=nq)
    stored = xs.take(place).combine_chunks()
    fields = [pa.array(np.sqrt(dist)), pa.array(ids[place], pa.int64()), *[whole(stored[c]) for c in payload]]
    items = pa.StructArray.from_arrays(fields, names=["distance", "id", *payload])
    near = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(counts)]).astype("int32"), items)
    return pa.table({"qid": qs["id"], "near": near}).filter(pa.array(counts > 0))


def whole(column):
    """An Arrow column in one piece."""
    import pyarrow as pa

    if not isinstance(column, pa.ChunkedArray):
        return column
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def first_k(row, dist, place, k: int):
    """The ``k`` least entries of every row by distance and place, sorted."""
    import numpy as np

    order = np.lexsort((place, dist, row))
    row, dist, place = row[order], dist[order], place[order]
    begin = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])) if len(row) else np.zeros(0, dtype=np.int64)
    rank = np.arange(len(row)) - np.repeat(begin, np.diff(np.append(begin, len(row))))
    keep = rank < k
    return row[keep], dist[keep], place[keep]


def kth(row, dist, rows, k: int):
    """The k-th distance of each of the ``rows`` among entries sorted by row and distance; infinite where there are fewer."""
    import numpy as np

    begin, end = np.searchsorted(row, rows, "left"), np.searchsorted(row, rows, "right")
    out = np.full(len(rows), np.inf)
    full = end - begin >= k
    out[full] = dist[begin[full] + k - 1]
    return out


def knn(
    queries: DataFrame,
    index: DataFrame,
    k: int,
    *,
    metric: str = "l2",
    mask: str | None = None,
    payload: Sequence[str] = (),
    pivots: int = PIVOTS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The ``k`` nearest index rows of every query: ``qid, id, distance, rank`` and the payload.

    Both tables have ``id`` and ``vector``; ``mask`` names a column whose equal value excludes
    a pair (same episode, or the row itself). Ties in distance go to the smaller id.
    ``cosine`` searches the unit vectors, where both orders agree. The index is written for this
    call; ``NeighbourIndex`` keeps one for many.
    """
    made = NeighbourIndex.build(index, scratch(index.sparkSession, "neighbours"), metric, mask, payload, pivots, block_rows)
    return made.search(queries, k, mask)


def outcome_stats(neighbours: DataFrame, outcome: str) -> DataFrame:
    """Neighbour count, mean outcome and population spread per query."""
    return neighbours.groupBy("qid").agg(
        F.count(F.lit(1)).alias("n"), F.avg(outcome).alias("mean"), F.stddev_pop(outcome).alias("sigma"), F.avg("distance").alias("mean_distance")
    )


def spread_summary(stats: DataFrame, base_rate: float, low: float = V.SPREAD_LOW, high: float = V.SPREAD_HIGH, zero: float = V.SPREAD_ZERO) -> DataFrame:
    """Quantiles of the spread, shares in, below and above the band, the cap and a verdict."""
    folder = scratch(stats.sparkSession, "spread")  # read several times below, so the neighbours are searched once
    stats.select("sigma").write.parquet(folder)
    stats = stats.sparkSession.read.schema("sigma double").parquet(folder)
    s = F.col("sigma")
    shares = stats.agg(
        F.avg(s.between(low, high).cast("double")).alias("in_band"), F.avg((s < low).cast("double")).alias("below"),
        F.avg((s > high).cast("double")).alias("above"), F.avg((s < zero).cast("double")).alias("zero_share"),
        F.count(F.lit(1)).alias("n"),
    )
    q = quantiles(stats, [], "sigma", {"p25": 0.25, "median": 0.5, "p75": 0.75})
    verdict = F.when(F.col("median") < low, "collapse").when(F.col("median") > high, "random").otherwise("pass")
    return q.join(shares, "n").withColumns({"cap": F.lit((base_rate * (1 - base_rate)) ** 0.5), "verdict": verdict})


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def action_match(query_action: Column, action: Column) -> tuple[Column, Column]:
    """(matched, cosine). A zero query action falls back to the same first component, cosine null."""
    qn, an = F.sqrt(dot(query_action, query_action)), F.sqrt(dot(action, action))
    cos = dot(action, query_action) / (F.greatest(an, F.lit(1e-8)) * qn)
    still = qn < 1e-8
    matched = F.when(still, F.abs(action[0] - query_action[0]) < 0.5).otherwise(cos > V.ACTION_SIMILARITY)
    return matched, F.when(~still, cos)


def values(neighbours: DataFrame, queries: DataFrame, outcome: str, action: str, k_min: int = V.MIN_MATCHES) -> DataFrame:
    """State value V, action value Q, and the advantage (0 below ``k_min`` matches), with diagnostics.

    ``queries`` holds ``id`` and ``action``; a query without neighbours gets 0.5 for both values.
    """
    asked = queries.select(F.col("id").cast("long").alias("qid"), F.transform("action", lambda x: x.cast("double")).alias("__qa"))
    pairs = join_on(neighbours, asked, ["qid"], "inner")
    matched, cos = action_match(F.col("__qa"), F.transform(F.col(action), lambda x: x.cast("double")))
    rows = pairs.withColumns({"__m": matched, "__cos": cos})
    g = rows.groupBy("qid").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("__m").alias("matched"), F.avg(outcome).alias("v"),
        F.avg(F.when(F.col("__m"), F.col(outcome))).alias("__q"), F.stddev_pop(outcome).alias("outcome_std"),
        F.min("__cos").alias("cos_min"), F.max("__cos").alias("cos_max"), F.avg("__cos").alias("cos_mean"),
    )
    full = join_on(asked.drop("__qa"), g, ["qid"], "left")
    v = F.coalesce("v", F.lit(0.5))
    q = F.coalesce("__q", v)
    sure = F.coalesce(F.col("matched") >= k_min, F.lit(False))
    return full.select(
        "qid", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("matched", F.lit(0)).alias("matched"), v.alias("v"), q.alias("q"), sure.alias("confident"),
        F.when(sure, q - v).otherwise(0.0).alias("advantage"), "outcome_std", "cos_min", "cos_max", "cos_mean",
    )
