"""Embedding near-dedup by product quantisation.

Coarse centroids (k-means on unit vectors) make inverted lists; the residual of every
vector is cut into subspaces and stored as one code byte per subspace, with the length
of the rest that the codes miss. Centroids and codebooks are fitted on a sample of at
most ``SAMPLE`` vectors, those with the least hash of their id; every row is indexed.

Lists hold about ``LIST_SIZE`` vectors, so their number grows with the table. A query
probes the ``PROBES`` lists whose centroids are nearest to it, but for lists that cannot
hold a link: with r the distance that belongs to the cosine limit, a vector of list B is
nearer to B's centroid b than to the query's own centroid a, so
(|q-b|^2 - |q-a|^2) / (2 |a-b|) <= r for every link. A link is looked for from both of its
sides; found from one only (which the tests' vectors show for none in a thousand), it
joins the two and counts for the side that found it. Within a list, table
look-ups add up the asymmetric distance from the query to each coded vector. Its square
exceeds the true one by the square of the vector's missed rest and by twice the product of
both times the cosine between them, which is near zero in many dimensions; pairs within r
at a cosine of up to ``SLACK`` are compared by their exact cosine in double precision, and
only these. Tests measure the recall against brute force.

Equal vectors are one class (128-bit hash of the components) with a count. A list is cut
into chunks of about ``CHUNK`` classes. In each, ``BALL`` or more classes within half of r
of one of them, the leader, become a *ball*: all of it is linked. Queries first meet the
leaders and the classes in no ball. A ball that lies within r as a whole adds its number
and one link; one that lies beyond r adds nothing; only queries whose limit cuts a ball go
on to that ball's chunk. So a tight blob of a third of all vectors costs each query one
leader per ``CHUNK`` of its classes. A dense list that is no tight blob stays quadratic in
its size, since every link counts in n_links.

Every length of vectors has an index of its own (one run of the jobs for each).

Memory of a task: up to ``LISTS`` neighbouring lists of together at most ``CHUNK`` leaders
and single classes are held by one task, a longer list chunk by chunk; the queries that
probe them arrive once, in blocks of about ``ASK_BLOCK``, so a task holds about ASK_BLOCK + CHUNK vectors (each
three times: bytes, components, unit length) and products of QUERY_BLOCK x CHUNK. A query's
hits are reduced as they are found to a number and one link per connected part of the
chunk; pairs are never listed.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components
link with nothing (n_links 0, component_id their vec_id, kept); vectors of different
lengths do not link; components of any finite size count; repeated rows are equal vectors; null ids are kept rows of their own that
count as equal vectors do; ties go to the least id; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillsight.llm.graph import components, stored

COSINE = 0.9
SAMPLE = 20_000
LIST_SIZE, MOST_LISTS, SUBSPACES, CODES = 512, 2048, 16, 256
PROBES, SLACK = 16, 0.75
CHUNK, ASK_BLOCK, QUERY_BLOCK, PAIRS = 2048, 8192, 128, 1 << 16
#: Lists of a task at most; classes of a ball at least.
LISTS, BALL = 8, 8


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centre = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = nearest(x, centre)
        n = np.bincount(own, minlength=len(centre))
        total = np.zeros_like(centre)
        np.add.at(total, own, x)
        centre[n > 0] = total[n > 0] / n[n > 0, None]
    return centre


def nearest(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    half = (centre ** 2).sum(1) / 2
    return np.concatenate([(half - x[i:i + 4096] @ centre.T).argmin(1)
                           for i in range(0, len(x), 4096)]) if len(x) else np.empty(0, int)


def fit(sample: np.ndarray, n: int) -> dict:
    """Centroids and residual codebooks for a table of ``n`` unit vectors."""
    centre = kmeans(sample, min(len(sample), MOST_LISTS, max(1, n // LIST_SIZE)))
    rest = sample - centre[nearest(sample, centre)]
    cuts = np.array_split(np.arange(sample.shape[1]), min(SUBSPACES, sample.shape[1]))
    return {"centre": centre, "cuts": cuts,
            "books": [kmeans(rest[:, c], min(CODES, len(rest))) for c in cuts]}


def encode(x: np.ndarray, index: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """List, codes and missed rest of unit vectors."""
    own = nearest(x, index["centre"])
    rest = x - index["centre"][own]
    code = np.empty((len(x), len(index["cuts"])), np.uint8)
    for i, (cut, book) in enumerate(zip(index["cuts"], index["books"])):
        code[:, i] = nearest(rest[:, cut], book)
        rest[:, cut] -= book[code[:, i]]
    return own, code, np.sqrt((rest ** 2).sum(1))


def probes(x: np.ndarray, own: np.ndarray, index: dict, reach: float) -> list[np.ndarray]:
    """The nearest lists of each query, of those that may hold a vector within ``reach``."""
    centre = index["centre"]
    square = (centre ** 2).sum(1)
    out = []
    for i in range(0, len(x), 1024):
        far = square - 2 * (x[i:i + 1024] @ centre.T)
        a = own[i:i + 1024]
        gap = np.sqrt(np.maximum(0, square[a][:, None] + square[None] - 2 * centre[a] @ centre.T))
        near = far - far[np.arange(len(a)), a][:, None] <= 2 * gap * (reach + 1e-9) + 1e-9
        far[~near] = np.inf
        if far.shape[1] > PROBES:
            rest = np.argpartition(far, PROBES, axis=1)[:, PROBES:]
            near[np.arange(len(a))[:, None], rest] = False
        out += [np.flatnonzero(row) for row in near]
    return out


def scaled(raw: np.ndarray) -> np.ndarray:
    """Vectors times a power of two each, which rounds nothing: squares of tiny or huge
    components would leave the range of doubles."""
    _, power = np.frexp(np.abs(raw).max(1, initial=0))
    half = power // 2   # in two steps, since one factor may leave the range itself
    return np.ldexp(np.ldexp(raw, -half[:, None]), -(power - half)[:, None])


def unit(raw: np.ndarray) -> np.ndarray:
    raw = scaled(raw)
    return raw / np.sqrt((raw ** 2).sum(1))[:, None]


def _vectors(column, size: int) -> np.ndarray:
    """Components as float64, from binary columns of 8-byte components."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, size)


def gathered(x: np.ndarray, reach: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Leader and radius of the ball of each unit vector; in no ball, itself and 0."""
    leader, radius = np.arange(len(x)), np.zeros(len(x))
    near = x @ x.T >= 1 - (reach / 2 - 1e-6) ** 2 / 2
    free = np.ones(len(x), bool)
    for i in np.argsort(-near.sum(1), kind="stable"):
        if not free[i]:
            continue
        own = np.flatnonzero(near[i] & free)
        if len(own) < least:
            continue
        free[own] = False
        leader[own] = i
        radius[own] = np.sqrt(((x[own] - x[i]) ** 2).sum(1)).max() + 1e-9
    return leader, radius


def parts(x: np.ndarray, cosine: float) -> np.ndarray:
    """The least index that each unit vector is connected with by sure links."""
    root = np.arange(len(x))
    near = x @ x.T >= cosine + 1e-9
    rows = np.flatnonzero(near.sum(1) > 1)
    changed = True
    while changed:
        changed = False
        for i in rows:
            m = np.flatnonzero(near[i])
            low = min(root[i], root[m].min())
            if root[i] != low or (root[m] != low).any():
                changed = True
                root[i] = low
                root[m] = low
    return root


def linked(queries: np.ndarray, members: np.ndarray, code: np.ndarray, rest: np.ndarray,
           radius: np.ndarray, centre: np.ndarray, index: dict, cosine: float, allowed=None):
    """Yield (query number, linked members, members whose ball the limit cuts) of a chunk;
    ``allowed`` tells which members some queries are asked about."""
    reach = np.sqrt(max(0.0, 2 - 2 * cosine))
    queries, members = scaled(queries), scaled(members)
    q_norm, m_norm = (np.sqrt((x ** 2).sum(1)) for x in (queries, members))
    q_unit = queries / q_norm[:, None]
    single = radius == 0
    within = reach + radius
    limit = (within ** 2 + rest ** 2 + 2 * SLACK * within * rest + 1e-6).astype(np.float32)
    for a in range(0, len(queries), QUERY_BLOCK):
        q = q_unit[a:a + QUERY_BLOCK] - centre
        distance = np.zeros((len(q), len(members)), np.float32)
        for i, (cut, book) in enumerate(zip(index["cuts"], index["books"])):
            part = q[:, cut]
            look_up = ((part[:, None] - book[None]) ** 2).sum(2).astype(np.float32)
            distance += look_up.take(code[:, i], axis=1)
        near = distance <= limit
        if allowed is not None:
            near &= allowed(a, a + len(q))
        # only what the codes let pass is compared
        row, m = np.nonzero(near)
        product = np.concatenate([np.empty(0), *(
            np.einsum("ij,ij->i", queries[a + row[i:i + PAIRS]], members[m[i:i + PAIRS]])
            for i in range(0, len(row), PAIRS))])
        product /= q_norm[a + row] * m_norm[m]
        sure = single[m] & (product >= cosine)
        far = np.sqrt(np.maximum(0, 2 - 2 * product)) - reach
        inside, cut = ~single[m] & (far <= -radius[m] - 1e-9), ~single[m] & (far <= radius[m] + 1e-9)
        cut &= ~inside
        hit = sure | inside | cut
        row, m, cut = row[hit], m[hit], cut[hit]
        ends = np.flatnonzero(np.diff(row, append=-1)) + 1
        for j, z in zip(np.concatenate([[0], ends[:-1]]) if len(ends) else (), ends):
            yield a + int(row[j]), m[j:z][~cut[j:z]], m[j:z][cut[j:z]]


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector."""
    size = F.coalesce(F.size("embedding"), F.lit(-1))
    lengths = [r[0] for r in vectors.select(size.alias("s")).where("s > 0").distinct().orderBy("s").collect()]
    out = _of_length(vectors.where(size <= (lengths or [0])[0]), (lengths or [1])[0], cosine)
    for n in lengths[1:]:   # one row per length
        out = out.union(_of_length(vectors.where(size == n), n, cosine))
    return out


def _of_length(vectors: DataFrame, length: int, cosine: float) -> DataFrame:
    spark = vectors.sparkSession
    id_kind = vectors.schema["vec_id"].dataType.simpleString()

    def read(batches):
        for batch in batches:
            body, hi, lo = [], [], []
            for v in batch.column("embedding").to_pylist():
                ok = v is not None and len(v) == length and None not in v
                x = np.array(v if ok else [], np.float64)
                ok = ok and bool(np.isfinite(x).all()) and bool((x != 0).any())
                h = xxhash.xxh3_128_intdigest(x.tobytes()) if ok else None
                body.append(x.tobytes() if ok else None)
                for out, half in ((hi, h and h >> 64), (lo, h and h & (1 << 64) - 1)):
                    out.append(None if half is None else half - (half >> 63 << 64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()),
                 pa.array(body, pa.binary())], ["vec_id", "hi", "lo", "body"])

    rows = vectors.select("vec_id", "embedding").mapInArrow(
        read, f"vec_id {id_kind}, hi long, lo long, body binary")
    classes = stored(rows.where("lo IS NOT NULL").groupBy("hi", "lo").agg(
        F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"),
        F.any_value("body").alias("body")), "vectors")
    n = classes.count()
    sample = classes.orderBy(F.xxhash64("lo"), "lo").limit(SAMPLE).select("body").toPandas()
    if n:
        x = np.frombuffer(b"".join(sample["body"]), np.float64).reshape(-1, length)
        index = spark.sparkContext.broadcast(fit(unit(x), n))
    else:
        index = spark.sparkContext.broadcast(None)
    reach = float(np.sqrt(max(0.0, 2 - 2 * cosine)))

    def code(batches):
        for batch in batches:
            x = unit(_vectors(batch.column("body"), length))
            own, codes, rest = encode(x, index.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("lo"), batch.column("copies"), batch.column("body"),
                 pa.array(own, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()),
                 pa.array(rest)], ["node", "copies", "body", "list", "code", "rest"])

    members = stored(classes.select("lo", "copies", "body").mapInArrow(
        code, "node long, copies long, body binary, list int, code binary, rest double"), "coded")
    # numbers per list: at most MOST_LISTS rows each
    def cut(counts: DataFrame, most: int) -> dict:
        return {r["list"]: -(-r["n"] // most) for r in
                counts.groupBy("list").agg(F.sum("n").alias("n")).collect()}

    homes = cut(members.select("list", F.lit(1).alias("n")), CHUNK)
    many = F.create_map(*[F.lit(x) for p in homes.items() for x in p]) if homes else None
    members = members.withColumn("home", F.pmod(F.xxhash64("node"), many[F.col("list")])
                                 .cast("int") if homes else F.lit(0))
    least, held_kind = BALL, ("node long, copies long, body binary, list int, code binary, "
                              "rest double, home int, ball long, radius double")

    def gather(held):
        held = held.sort_by("node").combine_chunks()
        nodes, copies = (held.column(c).to_numpy() for c in ("node", "copies"))
        leader, radius = gathered(unit(_vectors(held.column("body"), length)), reach, least)
        weight = np.bincount(leader, copies, len(nodes)).astype(np.int64)
        return (held.append_column("ball", pa.array(nodes[leader]))
                .append_column("radius", pa.array(radius))
                .append_column("weight", pa.array(weight)))

    balls = stored(members.groupBy("list", "home").applyInArrow(
        gather, held_kind + ", weight long"), "balls")
    leaders = balls.where("node = ball")
    # first chunk of each list, or -1, and the number of chunks from there
    leads = cut(leaders.select("list", F.lit(1).alias("n")), 1)
    first_of, pieces, room, lists_left = np.full(max(leads, default=0) + 1, -1), {}, 0, 0
    at = 0
    for l, n in sorted(leads.items()):
        if n > room or not lists_left:
            at += pieces[at] if at in pieces else 0
            pieces[at] = -(-n // CHUNK)
            room, lists_left = CHUNK if n <= CHUNK else 0, LISTS
        first_of[l] = at
        room, lists_left = max(0, room - n), lists_left - 1

    def probed(batch):
        x = unit(_vectors(batch.column("body"), length))
        own = batch.column("list").to_numpy()
        for a in range(0, len(x), 256):
            for i, near in enumerate(probes(x[a:a + 256], own[a:a + 256], index.value, reach)):
                near = near[near < len(first_of)]
                near = near[first_of[near] >= 0]
                firsts, starts = np.unique(first_of[near], return_index=True)
                yield a + i, firsts.tolist(), np.split(near, starts[1:])

    def number(batches):
        for batch in batches:
            n = Counter(f for _, firsts, _ in probed(batch) for f in firsts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(n), pa.int32()), pa.array(list(n.values()), pa.int64())],
                ["list", "n"])

    blocks = cut(balls.select("body", "list").mapInArrow(number, "list int, n long"), ASK_BLOCK)

    def dealt(nodes, number):
        return (nodes.astype(np.uint64) >> np.uint64(9)).astype(np.int64) % number

    def ask(batches):
        names = ["node", "copies", "ball", "body"]

        def out(batch, rows):
            row, lists, chunk, block = zip(*rows)
            pick = pa.array(row, pa.int32())
            return pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(pick) for c in names), pa.array(lists, pa.list_(pa.int32())),
                 pa.array(chunk, pa.int32()), pa.array(block, pa.int32())],
                [*names, "lists", "chunk", "block"])

        for batch in batches:
            nodes, rows = batch.column("node").to_numpy(), []
            for i, firsts, near in probed(batch):
                for f, lists in zip(firsts, near):
                    block = dealt(nodes[i], blocks[f])
                    for c in range(f, f + pieces[f]):
                        rows.append((i, lists, c, block))
                        if len(rows) == 10_000:
                            yield out(batch, rows)
                            rows = []
            if rows:
                yield out(batch, rows)

    def hold(batches):
        for batch in batches:
            nodes, lists = batch.column("node").to_numpy(), batch.column("list").to_pylist()
            for a in range(0, len(nodes), 256):
                rows = [(i, f + dealt(nodes[i], pieces[f]), b)
                        for i in range(a, min(a + 256, len(nodes)))
                        for f in [int(first_of[lists[i]])] for b in range(blocks.get(f, 0))]
                row, *keys = zip(*rows) if rows else ((),) * 3
                out = batch.take(pa.array(row, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [*out.columns, *(pa.array(k, pa.int32()) for k in keys)],
                    [*out.schema.names, "chunk", "block"])

    def side(held):
        held = held.sort_by("node").combine_chunks()
        nodes, radius, rest = (held.column(c).to_numpy() for c in ("node", "radius", "rest"))
        codes = np.frombuffer(b"".join(held.column("code").to_pylist()),
                              np.uint8).reshape(len(nodes), -1)
        return held, nodes, radius, codes, rest, _vectors(held.column("body"), length)

    out_kind = "a long, b array<long>, n long, body binary, list int, home int, balls array<long>"

    def compare(key, asked, held):
        rows = []
        if asked.num_rows and held.num_rows:
            held, nodes, radius, codes, rest, members = side(held)
            weight, home = (held.column(c).to_numpy() for c in ("weight", "home"))
            own, copies, ball = (asked.column(c).to_numpy() for c in ("node", "copies", "ball"))
            root = parts(unit(members), cosine)
            queries, body = _vectors(asked.column("body"), length), asked.column("body")
            in_list = held.column("list").to_numpy()
            to_list, who = (f(asked.column("lists").combine_chunks()).to_numpy()
                            for f in (pc.list_flatten, pc.list_parent_indices))
            for l in np.unique(in_list).tolist():
                at, of = np.flatnonzero(in_list == l), who[to_list == l]
                for q, m, open_ in linked(queries[of], members[at], codes[at], rest[at], radius[at],
                                          index.value["centre"][l], index.value, cosine):
                    q, m, open_ = of[q], at[m], at[open_]
                    n = int(weight[m].sum()) - (int(copies[q]) if (nodes[m] == ball[q]).any() else 0)
                    to = nodes[np.unique(root[m[nodes[m] != own[q]]])]
                    if n or len(to):
                        rows.append((int(own[q]), to.tolist(), n, None, None, None, None))
                    for h in np.unique(home[open_]).tolist():
                        rows.append((int(own[q]), None, None, body[q].as_py(), l, h,
                                     nodes[open_[home[open_] == h]].tolist()))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else ((),) * 7, (
            pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.int32(), pa.int32(),
            pa.list_(pa.int64())))], ["a", "b", "n", "body", "list", "home", "balls"])

    def compare_cut(key, asked, held):
        rows = []
        if asked.num_rows and held.num_rows:
            held, nodes, radius, codes, rest, members = side(held)
            ball, copies = (held.column(c).to_numpy() for c in ("ball", "copies"))
            asked_balls = asked.column("balls").to_pylist()
            allowed = lambda a, z: np.array([np.isin(ball, b) for b in asked_balls[a:z]])
            own = asked.column("a").to_pylist()
            for q, m, _ in linked(_vectors(asked.column("body"), length), members, codes, rest,
                                  np.zeros(len(nodes)), index.value["centre"][key[0].as_py()],
                                  index.value, cosine, allowed):
                rows.append((own[q], np.unique(ball[m]).tolist(), int(copies[m].sum())))
        a, b, n = zip(*rows) if rows else ((),) * 3
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.list_(pa.int64())),
                         "n": pa.array(n, pa.int64())})

    asked = balls.select("node", "copies", "ball", "body", "list").mapInArrow(
        ask, "node long, copies long, ball long, body binary, lists array<int>, "
             "chunk int, block int")
    held = leaders.mapInArrow(hold, held_kind + ", weight long, chunk int, block int")
    key = ["chunk", "block"]
    first = stored(asked.groupBy(*key).cogroup(held.groupBy(*key))
                   .applyInArrow(compare, out_kind), "vector_links")

    # balls that a query's limit cuts
    again = first.where("home IS NOT NULL")
    counts = again.groupBy("list", "home").agg(
        F.ceil(F.count("*") / ASK_BLOCK).cast("int").alias("blocks"))
    asked = (again.select("a", "body", "list", "home", "balls").join(counts, ["list", "home"])
             .withColumn("block", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int")))
    counts = counts.select(*[F.col(c).alias(c) for c in counts.columns])  # not the asked side's
    held = (balls.where("radius > 0").join(counts, ["list", "home"])
            .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))
    key = ["list", "home", "block"]
    second = stored(asked.groupBy(*key).cogroup(held.groupBy(*key))
                    .applyInArrow(compare_cut, "a long, b array<long>, n long"), "cut_links")
    links = first.where("home IS NULL").select("a", "b", "n").union(second)
    found = components(links.select("a", F.explode("b").alias("b")))
    numbers = links.groupBy("a").agg(F.sum("n").alias("n"))
    named = (classes.select("hi", "lo", "vec_id", "copies")
             .join(found.select(F.col("node").alias("lo"), "root"), "lo", "left")
             .join(numbers.withColumnRenamed("a", "lo"), "lo", "left")
             .withColumn("root", F.coalesce("root", "lo")))
    least = named.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    of_class = named.join(least, "root").select(
        "hi", "lo", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1)
        .alias("n_links"))
    out = rows.select("vec_id", "hi", "lo").join(of_class, ["hi", "lo"], "left")
    component = F.when(F.col("lo").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"),
                      F.col("vec_id").eqNullSafe(component).alias("kept"))
