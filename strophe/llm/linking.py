"""Variant spellings of names: weighted character n-grams, a sparse cosine join, average-linkage clusters.

1. Each distinct value is parsed once (Arrow batches); values of equal reading are one form.
2. Forms become unit vectors of n-grams: of characters by their reading (pairs next to each other or with one between, so an
   exchanged, added or lost character leaves most of them) and of letters (for slips of the keyboard), weighted by inverse document
   frequency over all forms; the root of the weight is taken, so that what the many spellings of one well-known name share still counts.
3. Pairs that reach the cosine of their field are found block against block: each two blocks of forms meet in one task, which sums the
   products of common n-grams up run by run. What is moved is a vector once per block, not each n-gram that a pair shares. There is no
   top-n cut, since no number of spellings is the largest possible: every partner above the threshold counts.
4. A pair is a link if it also passes an exact check, the name rule of its field (two brothers may share most of their n-grams).
   Only pairs whose lengths and letters the rule may accept leave their task.
5. Forms that links connect are clustered by average linkage on their cosines; pairs under the threshold count as 0.
6. Other names given beside a name, and cut-short first parts that fit one entity only, join clusters.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strophe.operators.components import connected
from strophe.operators.ordered import number_rows
from strophe.llm.naming import Form, Rule, is_short_of, same_name
from strophe.llm.readings import Readings
from strophe.session import cut, parallelism, release, spread

Parser = Callable[[str, Readings], "Form | None"]


def parse_values(values: DataFrame, kinds: dict[str, tuple[Parser, Rule]], readings: Readings) -> DataFrame:
    """``(field, value, label, letters, syllables, words, parts, latin, aliases)`` of distinct values that name something."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for f, v in zip(b["field"], b["value"]):
                x = kinds[f][0](v, readings)
                if x is not None:
                    out.append((f, v, x.label, x.letters, x.syllables, ["".join(q) for q in x.parts], json.dumps(x.parts, ensure_ascii=False), x.latin, ["".join(a) for a in x.aliases]))
            yield pd.DataFrame(out, columns=["field", "value", "label", "letters", "syllables", "words", "parts", "latin", "aliases"])

    schema = "field string, value string, label string, letters string, syllables array<string>, words array<string>, parts string, latin boolean, aliases array<string>"
    return spread(values.select("field", "value").where("value is not null").distinct()).mapInPandas(parse, schema)


def form_vectors(forms: DataFrame, kinds: dict[str, tuple[Parser, Rule]]) -> DataFrame:
    """Adds ``vec``: array of (df, gram, w), rarest first, w of unit norm, and ``t``, the threshold of the field. forms: (id, field,
    syllables, words, ...)."""
    of_field = lambda pick: F.create_map(*[F.lit(x) for f, (_, rule) in kinds.items() for x in (f, pick(rule))])[F.col("field")]
    forms = forms.withColumn("n", of_field(lambda r: r.letters)).withColumn("t", of_field(lambda r: r.cosine))
    # bigrams of neighbours and of those with one between; a name of one character is its own gram
    pairs = "transform(sequence(1, size(syllables) - {0}), i -> concat(syllables[i - 1], ' ', syllables[i + {0} - 1]))"
    by_character = f"case when size(syllables) > 2 then concat({pairs.format(1)}, {pairs.format(2)}) when size(syllables) = 2 then {pairs.format(1)} else syllables end"
    # a slip of the keyboard breaks a reading, but few of its letters; within words, since these may change places
    by_letter = "flatten(transform(words, w -> transform(sequence(1, greatest(1, length(w) - n + 1)), i -> concat('~', substring(w, i, n)))))"
    gram = F.expr(f"concat({by_character}, {by_letter})")
    g = forms.where("size(syllables) > 0").select("id", "field", F.explode(gram).alias("gram")).groupBy("id", "field", "gram").agg(F.count("*").alias("tf"))
    df = g.groupBy("field", "gram").agg(F.count("*").alias("df"))
    total = forms.groupBy("field").agg(F.count("*").alias("total"))
    w = g.join(df, ["field", "gram"]).join(total, "field").withColumn("w", F.sqrt(F.col("tf") * F.log1p(F.col("total") / F.col("df"))))
    v = w.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "gram", "w"))).alias("vec"))
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda acc, x: acc + x["w"] * x["w"]))
    v = v.withColumn("norm", norm)
    v = v.select("id", F.transform("vec", lambda x: F.struct(x["df"].alias("df"), x["gram"].alias("gram"), (x["w"] / F.col("norm")).alias("w"))).alias("vec"))
    return forms.drop("n").join(v, "id")


def pairs_in_blocks(forms: DataFrame, vectors: DataFrame, keys: list[str], kinds: dict[str, tuple[Parser, Rule]] | None = None, hot: int = 40_000) -> DataFrame:
    """``(h_a, h_b, id_a, id_b, field, cos, ...)``, h_a < h_b: the pairs of equal ``keys`` that reach the threshold of their field, each once.

    forms: (h, id, field, syllables, parts, latin) and the keys; h is a hash of the id. vectors: (h, t, grams, weights). A group of equal keys is
    dealt over blocks of at most about ``hot`` forms, and each two blocks (and each block with itself) meet in one task, which sums up the cosines of its
    forms in runs of rows; groups too small for blocks share tasks. So what is moved are the vectors, once per block, and never the
    n-grams that pairs share, which grow as the square of the forms. With ``kinds``, only those that the rule of their field
    may accept or that may be short forms are kept: lengths and counts of letters and syllables rule out nearly all others.
    """
    few = max(1, hot // 10)
    rules = {f: (rule.letter_edits, rule.syllable_edits, rule.short_first) for f, (_, rule) in (kinds or {}).items()}

    def meet(t: pa.Table) -> pa.Table:
        return meeting(t, rules)

    spark = forms.sparkSession
    forms = forms.withColumn("key", F.xxhash64(*keys))
    n = forms.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    tasks = max(parallelism(spark), -(-(n.agg(F.sum("n")).first()[0] or 0) // few))
    # a group of more than few forms has up to eight blocks, and more where these would be larger than hot
    blocks = F.greatest(F.ceil(F.col("n") / hot), F.least(F.ceil(F.col("n") / few), F.lit(8))).cast("int")
    x = forms.join(n.withColumn("blocks", blocks).drop("n"), "key").join(vectors, "h")
    mine = F.pmod(F.xxhash64("h", F.lit(1)), "blocks").cast("int")
    x = x.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    x = x.withColumn("bin", F.when(F.col("blocks") == 1, F.pmod("key", F.lit(tasks))).otherwise(F.col("key"))).withColumn("single", F.col("blocks") == 1)
    x = x.withColumn("low", F.least("mine", "other")).withColumn("high", F.greatest("mine", "other"))
    grams = F.transform("grams", lambda g: F.xxhash64("key", g))
    x = x.select("bin", "single", "low", "high", "mine", "h", "id", "field", "t", "syllables", "parts", "latin", grams.alias("grams"), "weights")
    x = x.repartition(tasks, "bin", "single", "low", "high")
    got = x.groupBy("bin", "single", "low", "high").applyInArrow(meet, "h_a long, h_b long, id_a string, id_b string, field string, cos double, t double, parts_a string, latin_a boolean, parts_b string, latin_b boolean")
    return got.withColumn("cos", F.round("cos", 6)).where("cos >= t").drop("t")


def bags(rows: np.ndarray, codes: np.ndarray, n: int, width: int) -> np.ndarray:
    """Counts of codes in each of n rows, codes modulo width: two rows differ by no more than their members do."""
    return np.bincount(rows * width + codes % width, minlength=n * width).reshape(n, width).astype(np.int16)


def meeting(t: pa.Table, rules: dict[str, tuple[int, int, bool]], most: int = 2_000_000) -> pa.Table:
    """The pairs of one task of ``pairs_in_blocks``: those of the low block with the high one, or of one block with itself. Rows are taken in
    runs of at most ``most`` cells and common n-grams (one row at least), so memory does not grow with what they share."""
    t = t.combine_chunks().sort_by("h")
    high, alone = t["mine"].to_numpy() == t["high"][0].as_py(), t["low"][0].as_py() == t["high"][0].as_py()
    h, least = t["h"].to_numpy(), t["t"].to_numpy()
    field, parts, ids = (np.array(t[c].to_pylist(), object) for c in ("field", "parts", "id"))
    latin = np.array(t["latin"].to_pylist(), bool)
    grams = t["grams"].combine_chunks()
    row = np.repeat(np.arange(len(t)), np.diff(grams.offsets.to_numpy()))
    gram = np.unique(grams.flatten().to_numpy(), return_inverse=True)[1]
    w = t["weights"].combine_chunks().flatten().to_numpy()
    # the entries of the side looked up, by n-gram
    there = np.ones(len(row), bool) if alone else high[row]
    order = np.flatnonzero(there)[np.argsort(gram[there], kind="stable")]
    held, held_w = row[order], w[order]
    count = np.bincount(gram[order], minlength=gram.max() + 1 if len(gram) else 0)
    start = np.cumsum(count) - count
    rows = np.arange(len(t)) if alone else np.flatnonzero(~high)
    first = np.searchsorted(row, np.arange(len(t) + 1))
    work = np.bincount(row, weights=count[gram], minlength=len(t)).astype(np.int64)
    if rules:
        each = t["syllables"].combine_chunks()
        joined = ["".join(x) for x in each.to_pylist()]
        sizes = np.array([len(x) for x in joined])
        letters = bags(np.repeat(np.arange(len(t)), sizes), np.frombuffer("".join(joined).encode("utf-32-le"), np.uint32).astype(np.int64), len(t), 32)
        lengths = np.diff(each.offsets.to_numpy())
        syllables = bags(np.repeat(np.arange(len(t)), lengths), each.flatten().dictionary_encode().indices.to_numpy(), len(t), 64)
        names: dict[str, int] = {}
        ends = np.array([[names.setdefault("".join(q), len(names)) for q in x] if len(x) == 2 else (-1, -1) for x in map(json.loads, parts)]).reshape(-1, 2)
        slips, moves, short = (np.array([rules[f][k] for f in field]) for k in range(3))
    out = []
    at = 0
    while at < len(rows):
        load = np.cumsum(work[rows[at : at + max(1, most // max(1, len(t)))]])
        upto = at + max(1, int(np.searchsorted(load, most, side="right")))
        run = rows[at:upto]
        at = upto
        mine = np.concatenate([np.arange(first[r], first[r + 1]) for r in run])
        c = count[gram[mine]]
        total = int(c.sum())
        if not total:
            continue
        hit = np.repeat(start[gram[mine]] - (np.cumsum(c) - c), c) + np.arange(total)
        cell = np.repeat((row[mine] - run[0]) * len(t), c) + held[hit]
        size = (int(run[-1]) - int(run[0]) + 1) * len(t)
        if size <= 4 * most or size <= 4 * total:
            cos = np.bincount(cell, weights=np.repeat(w[mine], c) * held_w[hit], minlength=size)
            cell = np.flatnonzero(cos)
            cos = cos[cell]
        else:  # rows of the two blocks lie far apart
            cell, back = np.unique(cell, return_inverse=True)
            cos = np.bincount(back, weights=np.repeat(w[mine], c) * held_w[hit])
        a, b = cell // len(t) + run[0], cell % len(t)
        ok = cos >= least[a] - 1e-6
        if alone:
            ok &= a < b
        a, b, cos = a[ok], b[ok], cos[ok]
        # h is in order, so the smaller row has the smaller hash; forms of one hash do not meet
        a, b = np.minimum(a, b), np.maximum(a, b)
        ok = (h[a] != h[b]) & (field[a] == field[b])
        if rules:
            either = latin[a] | latin[b]
            slip = (np.abs(sizes[a] - sizes[b]) <= np.where(either, slips[a], 0)) | (np.abs(lengths[a] - lengths[b]) <= moves[a])
            near = ends[a][:, :, None] == ends[b][:, None, :]
            cut_short = short[a] & (ends[a][:, 0] >= 0) & near.any((1, 2))
            ok &= slip | cut_short
            a, b, cos, either, cut_short = a[ok], b[ok], cos[ok], either[ok], cut_short[ok]
            far = np.abs(letters[a] - letters[b]).sum(1)
            ok = cut_short | (far <= np.where(either, 2 * slips[a], 0)) | (moves[a] > 0) & (np.abs(syllables[a] - syllables[b]).sum(1) <= moves[a])
        out.append((a[ok], b[ok], cos[ok]))
    a, b, cos = (np.concatenate([o[k] for o in out]) if out else np.zeros(0, np.int64 if k < 2 else float) for k in range(3))
    text = lambda v: pa.array(v.tolist(), pa.string())
    return pa.table({"h_a": h[a], "h_b": h[b], "id_a": text(ids[a]), "id_b": text(ids[b]), "field": text(field[a]), "cos": cos, "t": least[a], "parts_a": text(parts[a]), "latin_a": latin[a], "parts_b": text(parts[b]), "latin_b": latin[b]})


def compact(vectors: DataFrame) -> DataFrame:
    """``(h, t, grams, weights)`` of the vectors of ``form_vectors``, n-grams by their hashes."""
    return vectors.select(F.xxhash64("id").alias("h"), "t", F.transform("vec", lambda x: F.xxhash64(x["gram"])).alias("grams"), F.transform("vec", lambda x: x["w"].cast("float")).alias("weights"))


def candidate_pairs(vectors: DataFrame, hot: int = 40_000) -> DataFrame:
    """Distinct ``(h_a, h_b)`` of equal field and label that reach their threshold; h is a hash of the id."""
    return pairs_in_blocks(vectors.withColumn("h", F.xxhash64("id")).drop("t", "vec"), compact(vectors), ["field", "label"], hot=hot).select("h_a", "h_b")


def similar_forms(forms: DataFrame, kinds: dict[str, tuple[Parser, Rule]], vectors: DataFrame | None = None, only: bool = False) -> DataFrame:
    """``(id_a, id_b, cos, link, short)``: all pairs of at least the cosine of their field; link marks those that the rule accepts,
    short (1 or 2) those of which one has a cut-short first part. ``only``: no others than these. vectors: as ``compact`` gives them."""
    if vectors is None:
        vectors = cut(compact(form_vectors(forms, kinds)))
    pairs = pairs_in_blocks(forms.withColumn("h", F.xxhash64("id")), vectors, ["field", "label"], kinds if only else None)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            out = []
            for ia, ib, f, cos, pa, la, pb, lb in zip(*(p[c] for c in ("id_a", "id_b", "field", "cos", "parts_a", "latin_a", "parts_b", "latin_b"))):
                rule, xa, xb = kinds[f][1], json.loads(pa), json.loads(pb)
                short = 0
                if rule.short_first:
                    short = 1 if is_short_of(xa, xb) else 2 if is_short_of(xb, xa) else 0
                out.append((ia, ib, cos, not short and same_name(xa, la, xb, lb, rule) > 0, short))
            yield pd.DataFrame(out, columns=["id_a", "id_b", "cos", "link", "short"])

    got = pairs.mapInPandas(judge, "id_a string, id_b string, cos double, link boolean, short int")
    return got.where("link or short > 0") if only else got


def average_linkage(n: int, pairs: list[tuple[int, int, float]], cut_at: float, sizes: list[int] | None = None) -> list[int]:
    """Cluster numbers of n items: the two clusters of highest mean similarity merge while it is at least cut_at.
    Pairs not given count as 0. Ties merge the smallest numbers first. sizes: of items that are clusters already, with mean similarities."""
    sim = np.zeros((n, n))
    for i, j, s in pairs:
        sim[i, j] = sim[j, i] = max(s, sim[i, j])
    size = np.ones(n) if sizes is None else np.array(sizes, float)
    alive = np.ones(n, bool)
    label = np.arange(n)
    np.fill_diagonal(sim, -1)
    while True:
        k = int(np.argmax(sim))
        i, j = divmod(k, n)
        if sim[i, j] < cut_at:
            break
        i, j = min(i, j), max(i, j)
        row = (sim[i] * size[i] + sim[j] * size[j]) / (size[i] + size[j])
        sim[i], sim[:, i] = row, row
        sim[i, ~alive] = sim[~alive, i] = -1
        sim[i, i] = -1
        sim[j] = sim[:, j] = -1
        alive[j] = False
        size[i] += size[j]
        label[label == j] = i
    return label.tolist()


def cluster_links(pairs: DataFrame, cut_at: float = 0.12, most: int = 3000, comp: DataFrame | None = None) -> DataFrame:
    """``(id, cluster)`` of linked forms: average linkage on the cosines within each component of the links.

    pairs: (id_a, id_b, cos, link) of every pair above the threshold, linked or not; all others count as 0. comp: the components (node, root)
    where they are known; then pairs need no link, and only those within components. A component of more
    than ``most`` forms is not taken into one task: its clusters are merged in rounds, until no more than ``most`` are left
    that can still merge. Both ways give the same clusters.
    """
    if comp is None:
        comp = cut(connected(pairs.where("link"), "id_a", "id_b"))
    sizes = comp.groupBy("root").agg(F.count("*").alias("n"))
    # large components and their forms by number, forms in the order of their ids; numbers of small ones are not needed
    a, b = comp.select(F.col("node").alias("id_a"), "root"), comp.select(F.col("node").alias("id_b"), F.col("root").alias("root_b"))
    inside = cut(pairs.join(a, "id_a").join(b, "id_b").where("root = root_b").join(sizes, "root").select("root", "n", "id_a", "id_b", "cos"))

    def cluster(g: pd.DataFrame) -> pd.DataFrame:
        names = sorted(set(g["id_a"]) | set(g["id_b"]))
        at = {x: i for i, x in enumerate(names)}
        labels = average_linkage(len(names), [(at[x], at[y], s) for x, y, s in zip(g["id_a"], g["id_b"], g["cos"])], cut_at)
        return pd.DataFrame({"id": names, "cluster": [names[x] for x in labels]})

    small = inside.where(F.col("n") <= most)
    out = small.repartition(parallelism(pairs.sparkSession), "root").groupBy("root").applyInPandas(cluster, "id string, cluster string")
    big = sizes.where(F.col("n") > most)
    if big.isEmpty():
        return out
    # numbers over range partitions, so that no task orders a component alone
    big = number_rows(big.select("root"), ["root"], "r")
    all_ = number_rows(comp.join(big.select("root"), "root").select("root", "node"), ["root", "node"], "g")
    start = all_.groupBy("root").agg(F.min("g").alias("start")).join(big, "root")
    numbered = cut(all_.join(start, "root").select(F.col("r").cast("int").alias("r"), (F.col("g") - F.col("start") + 1).cast("int").alias("c"), "node"))
    number = lambda x: numbered.select("r", F.col("c").alias(x), F.col("node").alias(f"id_{x}"))
    sims = inside.where(F.col("n") > most).join(number("a"), "id_a").join(number("b"), ["r", "id_b"])
    sims = sims.select("r", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("cos").alias("s"))
    labels = link_in_rounds(numbered.select("r", "c"), sims, cut_at, most)
    first = numbered.select("r", F.col("c").alias("label"), F.col("node").alias("cluster"))
    return out.unionAll(numbered.select("r", "c", F.col("node").alias("id")).join(labels, ["r", "c"]).join(first, ["r", "label"]).select("id", "cluster"))


def link_in_rounds(items: DataFrame, sims: DataFrame, cut_at: float, most: int) -> DataFrame:
    """``(r, c, label)``: average linkage of the items (r, c) of each r; sims: (r, a, b, s), each pair a < b once, others count as 0.

    Each round merges all pairs of clusters that are each other's best. A merged cluster is no nearer to a third than its nearer
    half was, so the order of merges far apart does not matter and the clusters are those of average_linkage. Ties are decided
    by the hash of a pair (by the smallest number, one cluster would take up the others one a round). Clusters without a partner at
    cut_at are done. Once no r has more than ``most`` others, each r is finished in one task.
    """
    label = cut(items.withColumn("label", F.col("c")))
    pairs = cut(sims.withColumn("t", F.xxhash64("r", "a", "b")))
    while True:
        size = label.groupBy("r", "label").agg(F.count("*").alias("n"))
        n_of = lambda x: size.select("r", F.col("label").alias(x), F.col("n").alias(f"n{x}"))  # noqa: B023, E731
        p = cut(pairs.join(n_of("a"), ["r", "a"]).join(n_of("b"), ["r", "b"]).withColumn("m", F.round(F.col("s") / F.col("na") / F.col("nb"), 12)))
        ends = p.select("r", F.explode(F.array("a", "b")).alias("x"), F.struct("m", "t", "a", "b").alias("k"))
        best = cut(ends.groupBy("r", "x").agg(F.max("k").alias("k")).where(F.col("k.m") >= cut_at))
        # pairs of clusters that are done have no part in what follows
        live = p.join(best.select("r", F.col("x").alias("a")), ["r", "a"]).join(best.select("r", F.col("x").alias("b")), ["r", "b"])
        most_left = best.groupBy("r").agg(F.count("*").alias("left")).agg(F.max("left")).first()[0]
        if most_left is None:
            return label
        if most_left <= most:
            break
        mutual = best.groupBy("r", "k.a", "k.b").agg(F.count("*").alias("both")).where("both = 2")
        to = cut(mutual.select("r", F.col("b").alias("old"), F.col("a").alias("new")))
        moved = lambda df, x: df.join(to.withColumnRenamed("old", x), ["r", x], "left").withColumn(x, F.coalesce("new", x)).drop("new")  # noqa: B023, E731
        label = cut(moved(label, "label").select("r", "c", "label"))
        live = moved(moved(live.select("r", "a", "b", "s", "t"), "a"), "b").where("a <> b")
        pairs = live.groupBy("r", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("s").alias("s"), F.max("t").alias("t"))

    def finish(g: pd.DataFrame) -> pd.DataFrame:
        sizes = dict(zip(g["a"].tolist(), g["na"].tolist())) | dict(zip(g["b"].tolist(), g["nb"].tolist()))
        names = sorted(sizes)
        at = {x: i for i, x in enumerate(names)}
        got = average_linkage(len(names), [(at[a], at[b], m) for a, b, m in zip(g["a"].tolist(), g["b"].tolist(), g["m"].tolist())], cut_at, [sizes[x] for x in names])
        return pd.DataFrame({"r": [int(g["r"].iloc[0])] * len(names), "label": names, "new": [names[x] for x in got]})

    to = live.select("r", "a", "b", "na", "nb", "m").groupBy("r").applyInPandas(finish, "r int, label int, new int")
    return label.join(to, ["r", "label"], "left").select("r", "c", F.coalesce("new", "label").alias("label"))


def link_spellings(values: DataFrame, kinds: dict[str, tuple[Parser, Rule]], readings: Readings) -> DataFrame:
    """``(field, value, entity)``: distinct values that name something, with the id of the entity named.

    values: (field, value), other columns ignored, repeated rows and nulls allowed. kinds: field to parser and rule.
    Missing values, words for unknown and values that name nothing give no row. An empty table gives no rows.
    """
    parsed = cut(parse_values(values, kinds, readings))
    ident = F.concat_ws("\x1f", "field", "label", "letters")
    parsed = parsed.withColumn("id", ident)
    best = F.max_by(F.struct("parts", "syllables", "words"), F.struct(F.length("parts"), F.col("parts"))).alias("b")
    forms = parsed.groupBy("id", "field", "label", "letters").agg(best, F.max("latin").alias("latin")).select("id", "field", "label", "letters", "b.parts", "b.syllables", "b.words", "latin")
    forms = cut(forms)
    vectors = cut(compact(form_vectors(forms, kinds)))
    links = cut(similar_forms(forms, kinds, vectors, only=True))
    # most pairs above the threshold lie in no component: they are not written, and those within are compared again
    comp = cut(connected(links.where("link"), "id_a", "id_b"))
    linked = forms.withColumn("h", F.xxhash64("id")).join(comp.withColumnRenamed("node", "id"), "id")
    inside = cut(pairs_in_blocks(linked, vectors, ["root"]).select("id_a", "id_b", "cos"))
    release(vectors)
    cluster = cut(forms.join(cluster_links(inside, comp=comp), "id", "left").select("id", F.coalesce("cluster", "id").alias("cluster")))
    release(inside)

    # a cut-short first part joins the one cluster it fits; where it fits several it stays alone
    short = links.where("short > 0").select(F.when(F.col("short") == 1, F.col("id_a")).otherwise(F.col("id_b")).alias("s"), F.when(F.col("short") == 1, F.col("id_b")).otherwise(F.col("id_a")).alias("id"))
    fit = short.join(cluster, "id").groupBy("s").agg(F.min("cluster").alias("t"), F.count_distinct("cluster").alias("k")).where("k = 1")
    fit = fit.join(cluster.withColumnRenamed("id", "s"), "s").select(F.col("cluster").alias("a"), F.col("t").alias("b"))
    # names given beside a name are names of the same entity
    beside = parsed.select("id", "field", F.explode("aliases").alias("alias")).select("id", F.concat_ws("\x1f", "field", F.lit(""), "alias").alias("other"))
    known = cluster.select(F.col("id").alias("other"), F.col("cluster").alias("b0"))
    beside = beside.join(cluster, "id").join(known, "other", "left").select(F.col("cluster").alias("a"), F.coalesce("b0", "other").alias("b"))
    merged = connected(fit.unionAll(beside).distinct(), "a", "b").select(F.col("node").alias("cluster"), "root")
    top = cluster.join(merged, "cluster", "left").select("id", F.coalesce("root", "cluster").alias("entity"))
    return parsed.select("field", "value", "id").join(top, "id").select("field", "value", "entity")
