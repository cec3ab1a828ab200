"""Queries that SQL cannot state, over their whole smallest tables, against plain programs written without the library."""

import itertools
import statistics as st

import numpy as np
import pytest
from pyspark.sql import functions as F

from strophe.plans import extras, learning, models, music, statistics as plans_statistics


def rows(spark, data, name):
    return spark.read.parquet(f"{data}/{name}.parquet").collect()


def by_item(spark, data):
    """Notes of each user as (onset in seconds, length, pitch, event, kind, value) in order."""
    out = {}
    for r in sorted(rows(spark, data, "events"), key=lambda r: (r.ts, r.event_id)):
        out.setdefault(r.user_id, []).append(r)
    return {u: [((r.ts - rs[0].ts).total_seconds(), r.value * 30, 36 + int(r.value // 1) % 48, r.event_id, r.event_type, r.value) for r in rs] for u, rs in out.items()}


def common(a, b):
    """Length of the longest common subsequence, by the whole table."""
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_fuzzy_titles(spark, data):
    x = {r.song_key for r in rows(spark, data, "recordings") if r.song_key and len(r.song_key) >= 3 and "#" not in r.song_key}
    y = {r.song_key for r in rows(spark, data, "scores") if r.song_key and len(r.song_key) >= 3}
    want = {}
    for a, b in itertools.product(x, y):
        if 160 * max(len(a), len(b)) <= 200 * (len(a) + len(b)):  # all can reach the ratio otherwise
            ratio = 200 * common(a, b) / (len(a) + len(b))
            if ratio >= 80:
                want[a, b] = round(ratio, 6)
    got = {(r.song_key, r.score_key): round(r.ratio, 6) for r in models.fuzzy_titles(spark, data).collect()}
    assert got == want and want


def test_note_f1(spark, data):
    want = {}
    for u, ns in by_item(spark, data).items():
        ref = [(o / 3600, p) for o, _, p, e, _, _ in ns if e % 5 != 0]
        est = [(o / 3600, p) for o, _, p, e, _, _ in ns if e % 3 != 0]
        mate = {}

        def grow(i, seen):
            for j, (o, p) in enumerate(est):
                if j not in seen and abs(o - ref[i][0]) <= 1 and abs(p - ref[i][1]) <= 0.5:
                    seen.add(j)
                    if j not in mate or grow(mate[j], seen):
                        mate[j] = i
                        return True
            return False

        n = sum(grow(i, set()) for i in range(len(ref)))
        p, r = n / max(1, len(est)), n / max(1, len(ref))
        want[u] = (p, r, 2 * p * r / (p + r) if n else 0.0)
    got = {x.item: (x.precision, x.recall, x.f1) for x in models.note_f1(spark, data).collect()}
    assert set(got) == set(want) and all(np.allclose(got[u], want[u]) for u in want)


def test_matching_within_runs(spark):
    """Dense notes, where greedy matching is not the largest, over several items and batches."""
    rng = np.random.default_rng(4)
    rows_ = [(i % 3, float(rng.uniform(0, 12)), int(rng.integers(60, 62)), bool(rng.random() < 0.6), bool(rng.random() < 0.6)) for i in range(150)]
    df = spark.createDataFrame(rows_, "item long, onset double, pitch int, ref boolean, est boolean")
    for k, r in ((r.item, r) for r in models.matched_notes(df, 0.2, 0.5).collect()):
        ref, est = [x for x in rows_ if x[0] == k and x[3]], [x for x in rows_ if x[0] == k and x[4]]
        mate = {}

        def grow(i, seen):
            for j, e in enumerate(est):
                if j not in seen and abs(e[1] - ref[i][1]) <= 0.2 and e[2] == ref[i][2]:
                    seen.add(j)
                    if j not in mate or grow(mate[j], seen):
                        mate[j] = i
                        return True
            return False

        n = sum(grow(i, set()) for i in range(len(ref)))
        assert abs(r.precision - n / len(est)) < 1e-12 and abs(r.recall - n / len(ref)) < 1e-12
    assert models.matched_notes(df.where("false"), 0.2, 0.5).count() == 0


def test_melodic_alignment(spark, data):
    seqs = {u: [p for _, _, p, *_ in ns] for u, ns in by_item(spark, data).items()}

    def local(q, x):
        best = 0
        for t in range(12):
            h = [[0] * (len(x) + 1) for _ in range(len(q) + 1)]
            for i, a in enumerate(q):
                for j, b in enumerate(x):
                    h[i + 1][j + 1] = max(0, h[i][j] + (2 if (a + t - b) % 12 == 0 else -1), h[i][j + 1] - 1, h[i + 1][j] - 1)
                    best = max(best, h[i + 1][j + 1])
        return best / (2 * len(q))

    got = {r.item: r for r in models.melodic_alignment(spark, data).collect()}
    assert set(got) == {u for u in seqs if u + 1 in seqs}
    for u in sorted(got, key=lambda u: len(seqs[u]) * len(seqs[u + 1]))[:4]:
        assert got[u].other == u + 1 and (len(seqs[u]) < 8 or abs(got[u].local - local(seqs[u], seqs[u + 1])) < 1e-12)


def test_voted_notes(spark, data):
    want = set()
    for u, ns in by_item(spark, data).items():
        pitches = {}
        for o, d, p, e, _, _ in ns:
            for run in range(3):
                if (e + run) % 4:
                    pitches.setdefault(p, []).append((o / 3600 + run * 0.01, run, (o + d) / 3600))
        kept = []
        for p, xs in pitches.items():
            xs.sort()
            while xs:
                first, group = xs[0], []
                while xs and xs[0][0] - first[0] <= 0.05 and xs[0][1] not in [g[1] for g in group]:
                    group.append(xs.pop(0))
                if len(group) >= 2:
                    kept.append((st.median(g[0] for g in group), st.median(g[2] for g in group), p))
        kept.sort()
        for i, (s, e, p) in enumerate(kept):
            want.add((u, round(s, 6), round(min(e, kept[i + 1][0]) if i + 1 < len(kept) else e, 6), p))
    assert {(r.item, round(r.start, 6), round(r.end, 6), r.pitch) for r in models.voted_notes(spark, data).collect()} == want and want


def test_missed_segments(spark, data):
    want = []
    for u, ns in by_item(spark, data).items():
        pos = [(i + 1, o, v / 100) for i, (o, _, _, _, k, v) in enumerate(ns) if k != "error"]
        islands = []
        for p in pos:
            if islands and p[1] - islands[-1][-1][1] <= 43200:
                islands[-1].append(p)
            else:
                islands.append([p])
        for g in islands:
            cut = 0
            for i in range(len(g)):
                level = [x[2] for x in g[cut:i]]
                ahead = [x[2] for x in g[i : i + 5]]
                if len(level) >= 5 and len(ahead) == 5 and abs(g[i][2] - st.median(level)) >= 0.5 and abs(st.median(ahead) - st.median(level)) >= 0.5:
                    want.append((u, g[cut][0], i - cut, round(st.median(level), 9)))
                    cut = i
            want.append((u, g[cut][0], len(g) - cut, round(st.median(x[2] for x in g[cut:]), 9)))
    assert sorted((r.item, r.first, r.size, round(r.level, 9)) for r in extras.missed_segments(spark, data).collect()) == sorted(want)


def test_quantised_notes(spark, data):
    got = {}
    for r in music.quantised_notes(spark, data).collect():
        got.setdefault(r.item, []).append((r.start, r.length, r.pitch))
    for u, ns in by_item(spark, data).items():
        mine = sorted(got.get(u, []))
        assert all(a % 0.25 == 0 and n % 0.25 == 0 and n >= 0.25 for a, n, _ in mine)
        assert not mine or mine[0][0] == 0 and all(a + n == b for (a, n, _), (b, _, _) in zip(mine, mine[1:]))  # rests fill what is between
        assert [p for _, _, p in mine if p is not None] == [p for _, d, p in sorted((o / 3600, (o + d) / 3600 - o / 3600, p) for o, d, p, *_ in ns) if d >= 0.1]


def profiles(spark, data):
    by = {}
    for r in rows(spark, data, "embeddings"):
        by.setdefault(r.label, []).append(np.array(r.embedding, float))
    return by


def distances(spark, data):
    """Squared distances of the mean profiles without what the scatter of the rows adds."""
    by = profiles(spark, data)
    names = sorted(by)
    noise = {k: np.var(np.stack(v), axis=0, ddof=1).sum() / len(v) for k, v in by.items()}
    d2 = np.array([[0.0 if a == b else np.sum((np.mean(by[a], axis=0) - np.mean(by[b], axis=0)) ** 2) - noise[a] - noise[b] for b in names] for a in names])
    return names, np.sqrt(np.maximum(d2, 0))


def linkage(d):
    """Clusters after each average-linkage merge, from all to one, with the height of the merge."""
    clusters = [[i] for i in range(len(d))]
    steps = [([list(c) for c in clusters], 0.0)]
    while len(clusters) > 1:
        mean = {(i, j): np.mean([d[a, b] for a in clusters[i] for b in clusters[j]]) for i, j in itertools.combinations(range(len(clusters)), 2)}
        i, j = min(mean, key=mean.get)
        h = mean[i, j]
        clusters = [c for k, c in enumerate(clusters) if k not in (i, j)] + [clusters[i] + clusters[j]]
        steps.append(([list(c) for c in clusters], h))
    return steps


def test_profile_tree(spark, data):
    names, d = distances(spark, data)
    steps = linkage(d)
    got = {r.label: r for r in extras.profile_tree(spark, data).collect()}
    assert set(got) == set(names)
    want = {frozenset(names[i] for i in c) for c in steps[len(names) - 3][0]}
    assert {frozenset(n for n in names if got[n].cluster == k) for k in {r.cluster for r in got.values()}} == want
    assert all(abs(r.height - steps[-1][1]) < 1e-5 for r in got.values())


def test_matched_classes(spark, data):
    names, d = distances(spark, data)
    half = len(names) // 2
    got = sorted(extras.matched_classes(spark, data).collect(), key=lambda r: r.label)
    best = min(sum(d[i, half + p[i]] for i in range(half)) for p in itertools.permutations(range(len(names) - half), half))
    assert abs(sum(r.distance for r in got) - best) < 1e-4 and [r.label for r in got] == names[:half] and len({r.partner for r in got}) == half


def test_clade_support(spark, data):
    names, d = distances(spark, data)
    by = profiles(spark, data)
    plain = np.array([[np.linalg.norm(np.mean(by[a], axis=0) - np.mean(by[b], axis=0)) for b in names] for a in names])
    want = {"|".join(str(names[i]) for i in sorted(c, key=lambda i: names[i])) for cs, _ in linkage(plain)[1:-1] for c in cs if len(c) > 1}
    got = {r.clade: r.support for r in learning.clade_support(spark, data).collect()}
    assert {frozenset(k.split("|")) for k in got} == {frozenset(k.split("|")) for k in want} and all(0 <= s <= 1 for s in got.values())


def test_label_permutation(spark, data):
    names, d = distances(spark, data)
    got = {r.test: r for r in learning.label_permutation(spark, data).collect()}
    pairs = list(itertools.combinations(range(len(names)), 2))
    same = [d[i, j] for i, j in pairs if i % 2 == j % 2]
    other = [d[i, j] for i, j in pairs if i % 2 != j % 2]
    assert abs(got["contrast"].statistic - (np.mean(other) - np.mean(same)) / np.mean(same + other)) < 1e-5 and 0 < got["contrast"].p <= 1
    assert -1 <= got["mantel"].statistic <= 1 and 0 < got["mantel"].p <= 1


def test_folds_and_picks(spark, data):
    r = spark.read.parquet(f"{data}/recordings.parquet").where("channel_key is not null and channel_key not in ('', 'NA', 'nan', 'None')").select("item_id", "channel_key").distinct()
    f = plans_statistics.group_folds(spark, data).collect()
    assert sum(x.recordings for x in f) == r.count() and sum(x.channels for x in f) == r.select("channel_key").distinct().count() and len(f) == 5
    p = plans_statistics.representatives(spark, data).collect()
    full = {x.item_id: x for x in spark.read.parquet(f"{data}/recordings.parquet").collect()}
    for region in {x.region for x in p}:
        mine = [full[x.item_id] for x in p if x.region == region]
        assert len(mine) <= 8
        for c in ("song_key", "channel_key", "singer_id"):
            held = [m[c] for m in mine if m[c] is not None]
            assert len(held) == len(set(held))


@pytest.mark.parametrize("name", ["title_clusters", "strategy_accuracy", "transfer_accuracy", "cluster_sweeps", "learning_curve", "domain_weights", "dual_view"])
def test_ranges(spark, data, name):
    """What a model gives on the smallest tables: complete, and within its range; how good it is is tested where the answer is known."""
    got = learning.QUERIES[name](spark, data)
    if name == "title_clusters":
        titles = spark.read.parquet(f"{data}/recordings.parquet").where("title not in ('', 'NA', 'nan', 'None')").select("title").distinct()
        assert got.count() == titles.count() and got.join(titles, "title").count() == got.count() and got.where("cluster not between 0 and 14").isEmpty()
    elif name == "dual_view":
        assert got.count() == got.select("vec_id").distinct().count() > 0 and got.where("guess is null").isEmpty()
    elif name == "domain_weights":
        x = got.first()
        assert 0 < x.effective <= x.n + 1e-6 and 0 <= x.auc <= 1
    elif name == "cluster_sweeps":
        assert got.count() == 9 and got.where("nmi < 0 or nmi > 1").isEmpty()
    else:
        assert got.where(~F.col("accuracy").between(0, 1)).isEmpty() and got.count() >= 3
