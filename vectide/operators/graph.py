"""Similarity graphs of directions, their audits, and budgets of rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vectide.functions import vec
from vectide.functions.vec import INF

#: Nodes in a block; two blocks are multiplied at a time.
BLOCK = 2048


def blocked(nodes: DataFrame, entity: str | None, block: int, by: list[str] | None = None) -> DataFrame:
    """Every node in the row and the column of blocks that meet: ``by, id, entity, u, l, r, side``.

    Each node is sent to twice as many tasks as there are blocks: with a
    hundred thousand conditions about a hundred times. Nodes of different
    ``by`` (draws, say) never meet.
    """
    by = by or []
    most = nodes.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] if by else nodes.count()
    blocks = max(1, -(-(most or 0) // block))
    rows = nodes.select(*by, "id", (F.col(entity).cast("string") if entity else F.col("id")).alias("entity"), vec.doubles("u").alias("u"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("b"))
    every = F.sequence(F.lit(0), F.lit(blocks - 1))
    left = rows.select("*", F.explode(every).alias("o")).select(*by, "id", "entity", "u", F.col("b").alias("l"), F.col("o").alias("r"), F.lit(0).alias("side"))
    right = rows.select("*", F.explode(every).alias("o")).select(*by, "id", "entity", "u", F.col("o").alias("l"), F.col("b").alias("r"), F.lit(1).alias("side"))
    return left.unionByName(right)


def _cosines(f: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame, np.ndarray]:
    """Both sides of two blocks, and their cosines; those of one entity count as minus infinity."""
    a, b = f[f.side == 0].sort_values("id"), f[f.side == 1].sort_values("id")
    if not len(a) or not len(b):
        return a, b, np.zeros((len(a), len(b)))
    x, y = (np.array(g.u.tolist(), dtype=float) for g in (a, b))
    x, y = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300) for m in (x, y))
    c = x @ y.T
    c[a.entity.to_numpy()[:, None] == b.entity.to_numpy()[None, :]] = -np.inf
    return a, b, c


def knn(nodes: DataFrame, k: int, entity: str | None = None, block: int = BLOCK, by: list[str] | None = None) -> DataFrame:
    """``src, dst, rank, cos``: the k nearest others by cosine; ties by id. With ``by``, a graph for each of its values, in one product.

    nodes holds ``id`` (string), ``u`` (a vector of any length above 0) and, if named,
    an entity whose nodes are no neighbours of each other. Blocks of nodes meet
    pair by pair and pass on only their k best, so no task holds all nodes.
    """

    by = by or []

    def best(f: pd.DataFrame) -> pd.DataFrame:
        a, b, c = _cosines(f)
        return _best(a.id.to_numpy(), b.id.to_numpy(), c, k).assign(**{key: f[key].iloc[0] for key in by})

    own = "".join(f"`{key}` {nodes.schema[key].dataType.simpleString()}, " for key in by)
    found = blocked(nodes, entity, block, by).groupBy(*by, "l", "r").applyInPandas(best, f"{own}src string, dst string, cos double")
    return ranked(found, k, by)


def _best(src: np.ndarray, dst: np.ndarray, cos: np.ndarray, k: int) -> pd.DataFrame:
    """The k greatest cosines of each row above minus infinity; ties in order of the columns."""
    if not cos.size:
        none = np.zeros(0, dtype=object)  # an empty column must keep its kind
        return pd.DataFrame({"src": none, "dst": none, "cos": np.zeros(0)})
    top = np.argsort(-cos, axis=1, kind="stable")[:, :k]
    best = np.take_along_axis(cos, top, axis=1).reshape(-1)
    keep = best > -np.inf
    return pd.DataFrame({"src": np.repeat(np.asarray(src, dtype=object), top.shape[1])[keep], "dst": np.asarray(dst, dtype=object)[top.reshape(-1)][keep], "cos": best[keep]})


#: Pivots of a search at most; their vectors go to every task.
PIVOTS = 2048
#: Angles are told apart no finer than this: a bound skips only what lies beyond it.
SLACK = 1e-6
NODE = ["id", "entity", "u"]


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.array(vectors.tolist(), dtype=float)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ y.T, -1, 1))


class PivotSearch:
    """Exact nearest neighbours around pivots, by rounds that skip what the triangle inequality rules out.

    Nodes belong to the cell of their nearest pivot. Angles are a metric, so no
    node of a cell is nearer to a node than its angle to the pivot less the cell's
    radius. A first round looks into the nearest cells; the k-th best angle of each
    node then bounds which others it has to visit. Cells are split into blocks, so
    a crowded one is no larger in a task than others; visitors too come in blocks.

    nodes as for ``knn``; ``write`` returns a DataFrame as written, for what is read several times.
    """

    def __init__(self, nodes: DataFrame, write, entity: str | None = None, pivots: int | None = None, block: int = BLOCK) -> None:
        self.write, self.block = write, block
        rows = nodes.select("id", (F.col(entity).cast("string") if entity else F.col("id")).alias("entity"), vec.doubles("u").alias("u"))
        self.n = rows.count()
        pivots = min(PIVOTS, pivots or int(np.ceil(self.n**0.5)) or 1)
        chosen = rows.select("u", F.xxhash64("id").alias("h")).orderBy("h").limit(pivots).select("u").toPandas()
        self.pivots = p = _unit(chosen.u) if len(chosen) else np.zeros((0, 1))

        def placed(frames):
            for f in frames:
                if len(f):
                    a = _angles(_unit(f.u), p)
                    cell = a.argmin(axis=1)
                    yield f.assign(cell=cell.astype(np.int32), angle=a[np.arange(len(f)), cell])

        self.rows = write(rows.mapInPandas(placed, "id string, entity string, u array<double>, cell int, angle double"))
        cells = self.rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).toPandas()  # a row for each pivot
        self.size, self.radius = np.zeros(len(p), dtype=np.int64), np.full(len(p), -np.inf)
        self.size[cells.cell], self.radius[cells.cell] = cells.n, cells.radius
        self.compared = 0

    def _visit(self, visits: DataFrame, k: int) -> DataFrame:
        """The k best of what each visitor (id, entity, u, to) finds in the cells it goes to; blocks of visitors meet blocks of cells."""
        blocks = F.lit(np.maximum(1, -(-self.size // self.block)).tolist())
        members = self.rows.select("id", "entity", "u", F.col("cell").alias("to"), F.pmod(F.xxhash64("id"), blocks[F.col("cell")]).cast("int").alias("r"), F.lit(1).alias("side"))
        many = visits.groupBy("to").agg(F.count("*").alias("k")).toPandas()
        parts = np.ones(len(self.size), dtype=np.int64)
        parts[many.to] = np.maximum(1, -(-many.k // self.block))
        self.compared += int((self.size[many.to] * many.k).sum())
        parts = F.lit(parts.tolist())
        every = lambda n: F.explode(F.sequence(F.lit(0), (n - 1).cast("int")))
        left = visits.withColumn("l", F.pmod(F.xxhash64("id", F.lit(1)), parts[F.col("to")]).cast("int")).select("id", "entity", "u", "to", "l", F.lit(0).alias("side"), every(blocks[F.col("to")]).alias("r"))
        right = members.select("*", every(parts[F.col("to")]).alias("l"))

        def best(f: pd.DataFrame) -> pd.DataFrame:
            a, b, c = _cosines(f)
            return _best(a.id.to_numpy(), b.id.to_numpy(), c, k)

        return left.unionByName(right).groupBy("to", "l", "r").applyInPandas(best, "src string, dst string, cos double")

    def knn(self, k: int, near: int = 3) -> DataFrame:
        """``src, dst, rank, cos``, as ``knn`` gives them."""
        p, radius = self.pivots, self.radius
        self.compared = 0

        def first(frames):
            for f in frames:
                if len(f):
                    order = np.argsort(_angles(_unit(f.u), p) - np.where(radius > -np.inf, 0, -np.inf), axis=1)[:, :near]
                    yield f[NODE].assign(to=list(order.astype(np.int32)))

        def sent(rows: DataFrame, cells) -> DataFrame:
            return self.write(rows.mapInPandas(cells, "id string, entity string, u array<double>, to array<int>").withColumn("to", F.explode("to")))

        start = self.write(ranked(self._visit(sent(self.rows, first), k), k))
        kth = start.where(F.col("rank") == k).select(F.col("src").alias("id"), F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("cos")))).alias("bound"))

        def rest(frames):
            for f in frames:
                if len(f):
                    a = _angles(_unit(f.u), p)
                    done = np.argsort(a - np.where(radius > -np.inf, 0, -np.inf), axis=1)[:, :near]
                    open_ = (a - radius <= f.bound.to_numpy()[:, None] + SLACK) & (radius > -np.inf)
                    np.put_along_axis(open_, done, False, axis=1)
                    yield f[NODE].assign(to=[np.flatnonzero(row).astype(np.int32) for row in open_])

        bounded = self.rows.join(kth, "id", "left").withColumn("bound", F.coalesce("bound", F.lit(np.pi)))
        more = self._visit(sent(bounded, rest), k)
        return ranked(start.select("src", "dst", "cos").unionByName(more), k)

    def compared_share(self) -> float:
        """Which share of all pairs the last search compared."""
        return self.compared / max(1, self.n * self.n)

    def direction_self_join(self) -> DataFrame:
        """``src, n, best``, as ``direction_self_join`` gives them: counts come from entities, the greatest cosine from the search."""
        each = self.rows.groupBy("entity").agg(F.count("*").alias("own"))
        counts = self.rows.select(F.col("id").alias("src"), "entity").join(each, "entity").select("src", (F.lit(self.n) - F.col("own")).alias("n"))
        return counts.join(self.knn(1).select("src", F.col("cos").alias("best")), "src").select("src", "n", "best")


def direction_self_join(nodes: DataFrame, entity: str | None = None, block: int = BLOCK) -> DataFrame:
    """``src, n, best``: with how many nodes of other entities each node is compared, and the greatest cosine.

    All pairs meet block by block; a pair of blocks passes on one row for each node.
    """

    def best(f: pd.DataFrame) -> pd.DataFrame:
        a, _, c = _cosines(f)
        if not c.size:
            return pd.DataFrame({"src": np.zeros(0, dtype=object), "n": np.zeros(0, dtype=int), "best": np.zeros(0)})
        n = (c > -np.inf).sum(axis=1)
        return pd.DataFrame({"src": a.id.to_numpy(), "n": n, "best": c.max(axis=1)})[n > 0]

    found = blocked(nodes, entity, block).groupBy("l", "r").applyInPandas(best, "src string, n long, best double")
    return found.groupBy("src").agg(F.sum("n").alias("n"), F.max("best").alias("best"))


def ranked(edges: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    by = by or []
    order = Window.partitionBy(*by, "src").orderBy(F.desc(F.round("cos", 12)), "dst")
    return edges.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(*by, "src", "dst", "rank", "cos")


def nearest_groups(nodes: DataFrame, one: str, k: int = 3) -> DataFrame:
    """The k best neighbours of one node: a single pass, without the graph."""
    me = nodes.where(F.col("id") == one).select(F.col("u").alias("__u"))
    met = nodes.where(F.col("id") != one).crossJoin(F.broadcast(me)).select(F.col("id").alias("dst"), vec.cosine("u", "__u").alias("cos"))
    return met.orderBy(F.desc("cos"), "dst").limit(k)


def graph_jaccard(a: DataFrame, b: DataFrame) -> DataFrame:
    """The mean over nodes of shared neighbours over all neighbours in two graphs."""
    x = a.groupBy("src").agg(F.collect_set("dst").alias("x"))
    y = b.groupBy("src").agg(F.collect_set("dst").alias("y"))
    met = x.join(y, "src", "full").select(F.coalesce("x", F.array().cast("array<string>")).alias("x"), F.coalesce("y", F.array().cast("array<string>")).alias("y"))
    return met.agg(F.avg(F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y"))).alias("jaccard"), F.count("*").alias("nodes"))


def label_knn_accuracy(edges: DataFrame, labels: DataFrame, usable: Column) -> DataFrame:
    """The share of neighbours with the same label among usable nodes, and the majority's share."""
    good = labels.where(usable).select("id", "label")
    met = edges.join(good.select(F.col("id").alias("src"), F.col("label").alias("ls")), "src").join(good.select(F.col("id").alias("dst"), F.col("label").alias("ld")), "dst")
    hit = met.agg(F.avg((F.col("ls") == F.col("ld")).cast("double")).alias("accuracy"), F.count("*").alias("edges"))
    counts = good.groupBy("label").agg(F.count("*").alias("n"))
    return hit.crossJoin(F.broadcast(counts.agg((F.max("n") / F.sum("n")).alias("baseline"))))


def within_tolerance_fraction(df: DataFrame, angle: str, theta: float) -> DataFrame:
    return df.agg(F.avg((F.col(angle) <= theta).cast("double")).alias("within"))


def _uniform(*parts: Column) -> Column:
    return (F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("double") + 0.5) / float(2**32)


def normal_draw(*parts: Column) -> Column:
    """A standard normal that depends on its parts alone (md5 and Box-Muller)."""
    return F.sqrt(F.log(_uniform(F.lit("a"), *parts)) * -2) * F.cos(_uniform(F.lit("b"), *parts) * (2 * np.pi))


def parametric_replicates(nodes: DataFrame, draws: int, n: Column, seed: int = 0) -> DataFrame:
    """``id, draw, u``: directions of ``v`` plus noise of variance ``2 ell / n``."""
    rep = nodes.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    noisy = F.transform(
        F.arrays_zip("v", "ell"),
        lambda p, k: p["v"] + F.sqrt(p["ell"] * 2 / n) * normal_draw(F.col("id").cast("string"), F.col("draw").cast("string"), k.cast("string"), F.lit(str(seed))),
    )
    return rep.withColumn("e", noisy).select("id", "draw", "v", "e", vec.unit("e").alias("u"), vec.angle("e", "v").alias("angle"))


def allocate_flat(df: DataFrame, budget: float) -> DataFrame:
    """The budget split evenly."""
    n = df.agg(F.count("*").alias("__k"))
    return df.crossJoin(F.broadcast(n)).withColumn("rows", F.lit(float(budget)) / F.col("__k")).drop("__k")


def allocate_capped(df: DataFrame, cap: float) -> DataFrame:
    """Each condition its quota, at most the cap; an infinite quota takes the cap."""
    return df.withColumn("rows", F.least(F.col("n_star"), F.lit(float(cap))))


def budget_curve(df: DataFrame, caps: list[float], theta: float, target: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """What flat and capped budgets of the same size resolve, and the first budget to reach a target.

    A condition is resolved if its angle at the rows it gets, ``sqrt(tr_perp / (m2 n))``, is at most theta.
    saving is the ratio of the two first budgets; null if either is out of reach.
    """
    grid = df.sparkSession.createDataFrame([(float(c),) for c in caps], "cap double")
    each = df.select("cond_id", "n_star", "tr_perp", "m2_corr").crossJoin(F.broadcast(grid)).withColumn("capped", F.least("n_star", "cap"))
    flat = each.groupBy("cap").agg(F.sum("capped").alias("budget"), F.count("*").alias("k"))
    met = each.join(F.broadcast(flat), "cap")
    ok = lambda n: F.when(F.col("m2_corr") > 0, F.col("tr_perp") / (F.when(F.col("m2_corr") > 0, F.col("m2_corr")) * n) <= theta * theta).otherwise(False)
    curve = met.groupBy("cap", "budget").agg(F.avg(ok(F.col("capped")).cast("double")).alias("adaptive"), F.avg(ok(F.col("budget") / F.col("k")).cast("double")).alias("flat"))
    first = curve.agg(F.min(F.when(F.col("adaptive") >= target, F.col("budget"))).alias("first_adaptive"), F.min(F.when(F.col("flat") >= target, F.col("budget"))).alias("first_flat"))
    return curve, first.withColumn("saving", F.col("first_flat") / F.col("first_adaptive"))


def graph_budget_curve(nodes: DataFrame, caps: list[float], draws: int, theta: float, k: int, write, entity: str | None = None, block: int = BLOCK, seed: int = 0) -> DataFrame:
    """What flat and capped budgets of the same size recover of the similarity graph and of the directions.

    nodes hold id, v, ell, n_star and the entity. Every draw of every budget adds
    noise of variance ``2 ell / n`` to the directions; its graph is compared with
    that without noise. One row a cap: budget, rows a condition if flat, and of
    each scheme mean and spread (ddof 0) over draws of the share within theta and
    of the mean Jaccard likeness of neighbours.
    """
    keys = ["cap", "scheme", "draw"]
    own = [entity] if entity else []
    grid = nodes.sparkSession.createDataFrame([(float(c),) for c in caps], "cap double")
    each = nodes.select("id", *own, "v", "ell", "n_star").crossJoin(F.broadcast(grid)).withColumn("capped", F.least("n_star", "cap"))
    budget = each.groupBy("cap").agg(F.sum("capped").alias("budget"), F.avg("capped").alias("flat_rows"))
    both = each.join(F.broadcast(budget), "cap").select("*", F.explode(F.create_map(F.lit("adaptive"), F.col("capped"), F.lit("flat"), F.col("flat_rows"))).alias("scheme", "n"))
    drawn = both.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    label = F.concat_ws("|", "scheme", F.col("cap").cast("long"), "draw")
    noisy = F.transform(F.arrays_zip("v", "ell"), lambda p, i: p["v"] + F.sqrt(p["ell"] * 2 / F.col("n")) * normal_draw(F.col("id").cast("string"), label, i.cast("string"), F.lit(str(seed))))
    drawn = write(drawn.withColumn("e", noisy).select(*keys, "id", *own, vec.unit("e").alias("u"), (vec.angle("e", "v") <= theta).cast("double").alias("within")))

    whole = write(knn(nodes.select("id", *own, vec.unit("v").alias("u")), k, entity, block))
    found = knn(drawn, k, entity, block, keys).join(whole.select("src", "dst", F.lit(1).alias("both")), ["src", "dst"], "left")
    sizes = whole.groupBy("src").agg(F.count("*").alias("size"))
    shared = found.groupBy(*keys, "src").agg(F.count("*").alias("k"), F.coalesce(F.sum("both"), F.lit(0)).alias("both")).join(sizes, "src")
    likeness = shared.groupBy(*keys).agg(F.avg(F.col("both") / (F.col("k") + F.col("size") - F.col("both"))).alias("jaccard"))
    met = drawn.groupBy(*keys).agg(F.avg("within").alias("within")).join(likeness, keys)
    of = lambda scheme, c: F.when(F.col("scheme") == scheme, F.col(c))
    stats = [f(of(scheme, c)).alias(f"{scheme}_{c}{suffix}") for scheme in ("flat", "adaptive") for c in ("within", "jaccard") for f, suffix in ((F.avg, ""), (F.stddev_pop, "_sd"))]
    return budget.join(met.groupBy("cap").agg(*stats), "cap")


def first_to_target(curve: DataFrame, target: float = 0.5) -> DataFrame:
    """For each metric the first budgets at which flat and capped allocation reach the target, and their ratio; null if out of reach."""
    rows = []
    for c in ("jaccard", "within"):
        first = lambda scheme: F.min(F.when(F.col(f"{scheme}_{c}") >= target, F.col("budget"))).alias(scheme)  # noqa: E731, B023
        rows.append(curve.agg(F.lit(c).alias("metric"), first("flat"), first("adaptive")))
    return rows[0].unionByName(rows[1]).withColumn("saving", F.col("flat") / F.col("adaptive"))


def edge_flags(edges: DataFrame, flags: DataFrame, flag: str, by: list[str] | None = None) -> DataFrame:
    """Edges with the flag of both ends."""
    by = by or []
    a = flags.select(*by, F.col("id").alias("src"), F.col(flag).alias("flag_src"))
    b = flags.select(*by, F.col("id").alias("dst"), F.col(flag).alias("flag_dst"))
    return edges.join(a, "src").join(b, ["dst", *by])


def resolved_edge_audit(edges: DataFrame, swept: DataFrame) -> DataFrame:
    """The share of resolved (OVER) nodes and of edges with both ends resolved, for each theta."""
    flags = swept.select("theta", F.col("cond_id").alias("id"), (F.col("regime") == "OVER").alias("resolved"))
    nodes = flags.groupBy("theta").agg((F.avg(F.col("resolved").cast("double")) * 100).alias("pct_nodes"))
    both = edge_flags(edges, flags, "resolved", ["theta"]).groupBy("theta").agg((F.avg((F.col("flag_src") & F.col("flag_dst")).cast("double")) * 100).alias("pct_edges"))
    return nodes.join(both, "theta")


def cost_translation(df: DataFrame, cap: float, price: float) -> DataFrame:
    """A uniform design at the 90th percentile against capped quotas, over finite quotas."""
    finite = df.where(F.col("n_star") < F.lit(INF))
    s = finite.agg(F.count("*").alias("k"), F.percentile("n_star", F.lit(0.9)).alias("p90"), F.avg(F.least("n_star", F.lit(float(cap)))).alias("mean"))
    s = s.select("k", (F.col("p90") * F.col("k")).alias("uniform_rows"), (F.col("mean") * F.col("k")).alias("adaptive_rows"))
    return s.withColumns({"uniform_cost": F.col("uniform_rows") * price, "adaptive_cost": F.col("adaptive_rows") * price, "factor": F.col("uniform_rows") / F.col("adaptive_rows")})


def cap_nodes(nodes: DataFrame, most: int, seed: int = 0) -> DataFrame:
    """At most so many nodes, drawn without replacement by a keyed order."""
    return nodes.orderBy(F.md5(F.concat_ws("|", F.col("id").cast("string"), F.lit(str(seed)))), "id").limit(most)


def compare_metrics(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two metric sets ``name, value`` side by side; what is missing shows as '--'."""
    met = old.select("name", F.col("value").alias("old")).join(new.select("name", F.col("value").alias("new")), "name", "full")
    delta = F.when(F.col("old") != 0, (F.col("new") - F.col("old")) / F.when(F.col("old") != 0, F.abs("old")))
    text = lambda c: F.coalesce(F.format_string("%.6f", F.col(c)), F.lit("--"))
    return met.select("name", F.when(F.col("old").isNull(), "--").otherwise(text("old")).alias("old"), F.when(F.col("new").isNull(), "--").otherwise(text("new")).alias("new"), delta.alias("delta"))
