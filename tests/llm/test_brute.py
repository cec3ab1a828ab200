"""The queries over their whole smallest tables against plain programs that compare everything with everything."""

import itertools
import json
import math
from collections import Counter, defaultdict

import pytest

from strophe.llm import canonical, canonical_queries, documents_queries, names_queries, overlap_queries
from strophe.llm.leakage import fold_table, stream
from strophe.llm.linking import average_linkage
from strophe.llm.naming import is_short_of, same_name
from strophe.llm.readings import Readings

MISSING = (None, "", "NA", "nan", "None")


@pytest.fixture(scope="module")
def rec(spark, data):
    return spark.read.parquet(f"{data}/recordings.parquet").distinct().collect()


@pytest.fixture(scope="module")
def readings(spark, data):
    return Readings.load(spark.read.parquet(f"{data}/char_forms.parquet"))


def classes(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    out = defaultdict(set)
    for n in nodes:
        out[find(n)].add(n)
    return list(out.values())


def test_p3_every_pair_of_keys(spark, data, rec, readings):
    """No pair that the name rule accepts is lost by looking for common passages first."""
    parse, rule = overlap_queries.KEY["song_key"]
    rows = [r for r in rec if r.fold is not None and r.item_id is not None and r.song_key is not None and "#" not in r.song_key]
    forms = {k: f for k in {r.song_key for r in rows} if (f := parse(k, readings)) is not None}
    by = defaultdict(set)
    for k, f in forms.items():
        by[f.label, f.letters].add(k)
    evals = {(forms[r.song_key].label, forms[r.song_key].letters) for r in rows if r.fold >= 3 and r.song_key in forms}
    one = {i: max((forms[k] for k in ks), key=lambda f: (len(json.dumps(f.parts, ensure_ascii=False)), json.dumps(f.parts, ensure_ascii=False))) for i, ks in by.items()}
    latin = {i: max(forms[k].latin for k in ks) for i, ks in by.items()}
    links = [(a, b) for a in evals for b in by if a != b and a[0] == b[0] and same_name(one[a].parts, latin[a], one[b].parts, latin[b], rule) > 0]
    want = set()
    for c in classes(links, by):
        keys = {k for i in c for k in by[i]}
        train = {r.song_key for r in rows if r.fold <= 2} & keys
        want |= {(r.item_id, t) for r in rows if r.fold >= 3 and r.song_key in keys for t in train}
    got = {tuple(r) for r in overlap_queries.p3_found(spark, data).collect()}
    assert got == want and want
    held = {r.key for r in overlap_queries.p3_classes(spark, data).collect()}
    assert {r.song_key for r in rows if r.fold >= 3 and r.song_key in forms} <= held


def test_p4_every_pair_of_forms(spark, data, rec, readings):
    """Cosines of all pairs, average linkage within all components: the entities of the sparse join and its prefixes."""
    want = set()
    for field, (parse, rule) in names_queries.KINDS.items():
        values = {getattr(r, field) for r in rec} - {None}
        parsed = {v: f for v in values if (f := parse(v, readings)) is not None}
        by = defaultdict(list)
        for v, f in parsed.items():
            by[f.label, f.letters].append(f)
        key = lambda f: json.dumps(f.parts, ensure_ascii=False)
        one = {i: max(fs, key=lambda f: (len(key(f)), key(f))) for i, fs in by.items()}
        latin = {i: any(f.latin for f in fs) for i, fs in by.items()}
        grams = {}
        for i, f in one.items():
            s, n = f.syllables, rule.letters
            g = [" ".join(p) for p in zip(s, s[1:])] + [" ".join(p) for p in zip(s, s[2:])] if len(s) > 1 else list(s)
            grams[i] = Counter(g + ["~" + w[k : k + n] for w in ("".join(p) for p in f.parts) for k in range(max(1, len(w) - n + 1))])
        df = Counter(x for g in grams.values() for x in g)
        vec = {}
        for i, g in grams.items():
            w = {x: math.sqrt(t * math.log1p(len(grams) / df[x])) for x, t in g.items()}
            size = math.sqrt(sum(x * x for x in w.values()))
            vec[i] = {x: y / size for x, y in w.items()}
        cos = {}
        for a, b in itertools.combinations(sorted(by), 2):
            if a[0] == b[0] and (c := sum(y * vec[b].get(x, 0) for x, y in vec[a].items())) >= rule.cosine:
                cos[a, b] = round(c, 6)
        short = {p: 1 if is_short_of(one[p[0]].parts, one[p[1]].parts) else 2 if is_short_of(one[p[1]].parts, one[p[0]].parts) else 0 for p in cos} if rule.short_first else {}
        links = [p for p in cos if not short.get(p) and same_name(one[p[0]].parts, latin[p[0]], one[p[1]].parts, latin[p[1]], rule) > 0]
        entity = {i: i for i in by}
        for c in classes(links, by):
            names = sorted(c)
            label = average_linkage(len(names), [(i, j, cos[x, y]) for (i, x), (j, y) in itertools.combinations(enumerate(names), 2) if (x, y) in cos], 0.12)
            entity |= {x: names[k] for x, k in zip(names, label)}
        fits = defaultdict(set)
        for (a, b), s in short.items():
            if s:
                fits[a if s == 1 else b].add(entity[b if s == 1 else a])
        merged = [(entity[s], next(iter(t))) for s, t in fits.items() if len(t) == 1]
        nodes = set(entity.values())
        for v, f in parsed.items():
            for alias in f.aliases:
                other = ("", "".join(alias))
                nodes |= {entity.get(other, other)}
                merged.append((entity[f.label, f.letters], entity.get(other, other)))
        for c in classes(merged, nodes):
            members = sorted(v for v, f in parsed.items() if entity[f.label, f.letters] in c)
            want |= {(field, a, b) if a.encode("utf-32-be") < b.encode("utf-32-be") else (field, b, a) for a, b in itertools.combinations(members, 2)}
    assert {tuple(r) for r in names_queries.p4_found(spark, data).collect()} == want and want


def test_p1_every_entry(spark, data, rec, readings):
    """Every value against every entry, without blocking of tokens."""
    places = spark.read.parquet(f"{data}/gazetteer.parquet")
    entries = canonical_queries.gazetteer_entries(places).collect()
    exact = {("province" if p.level == "province" else "county_or_area", p.name) for p in places.collect()}
    bag, idf = defaultdict(dict), {}
    for e in entries:
        for stem, own in [*((p, False) for p in e.parents), (e.name, True)]:
            bag[e.field, e.entry][stem] = own or bag[e.field, e.entry].get(stem, False)
    for field in ("province", "county_or_area"):
        df = Counter(s for (f, _), b in bag.items() if f == field for s in b)
        total = sum(e.field == field for e in entries)
        idf |= {(field, s): math.log1p(total / n) for s, n in df.items()}
    syl = {s: readings.to_syllables(s) for _, s in idf}
    near = {}

    def sims(token):
        if token not in near:
            sy, latin = readings.to_syllables(token)
            near[token] = {s: x for s, (sb, _) in syl.items() if (x := canonical.token_similarity("".join(sy), sy, latin, "".join(sb), sb, token, s)) > 0}
        return near[token]

    longest = max(len(s) for _, s in idf)

    def scores(field, value):
        out = []
        parts = canonical.token_ways(value, readings, longest)
        if not parts or not all(parts):
            return out
        for e in entries:
            if e.field != field:
                continue
            b, best = bag[field, e.entry], []
            for ways in parts:
                ok = []
                for way in ways:
                    got = []
                    for token, kind in way:
                        c = [(x, idf[field, s], b[s], kind) for s, x in sims(token).items() if s in b]
                        if not c:
                            break
                        got.append(max(c))
                    else:
                        wrong = max(int(o and k != "" and k not in (e.kind, e.level)) for _, _, o, k in got)
                        met, all_ = sum(x * w * w for x, w, _, _ in got), sum(w * w for _, w, _, _ in got)
                        ok.append((any(o for _, _, o, _ in got), met / all_ - 0.05 * wrong - 0.001 * len(way), met, all_, wrong, len(way)))
                if not ok:
                    break
                best.append(max(ok))
            else:
                if any(x[0] for x in best):
                    out.append((sum(x[2] for x in best) / sum(x[3] for x in best) - 0.05 * max(x[4] for x in best) - 0.001 * sum(x[5] for x in best), e.entry, e.within))
        return out

    def choose(field, value, stated):
        c = scores(field, value)
        if not c:
            return None
        peak = max(x[0] for x in c)
        c = [x for x in c if x[0] >= peak - 0.12]
        c = [x for x in c if stated is not None and x[2] == stated] or c
        top = max(x[0] for x in c)
        c = [x for x in c if x[0] >= top - 0.004]
        return c[0][1] if len(c) == 1 else None

    want, known = set(), {}
    for r in rec:
        state = None
        if r.province not in MISSING:
            state = known.setdefault(("province", r.province, None), choose("province", r.province, None))
            if ("province", r.province) not in exact:
                want.add((r.item_id, "province", state or "unmatched"))
        if r.county_or_area not in MISSING and ("county_or_area", r.county_or_area) not in exact:
            k = ("county_or_area", r.county_or_area, state)
            if k not in known:
                known[k] = choose(*k)
            want.add((r.item_id, "county_or_area", known[k] or "unmatched"))
    assert {tuple(r) for r in canonical_queries.p1_found(spark, data).collect()} == want and want


def test_p9_every_item_in_every_document(spark, data, readings):
    """Every unaltered stretch of 20 words or 40 ideographs is found, and what is found shares most of a stretch of that size."""
    table = fold_table(readings.simplified)
    docs = {r.doc_id: stream(r.text or "", table) for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    items = {r.item_id: stream(r.text or "", table) for r in spark.read.parquet(f"{data}/eval_items.parquet").collect()}
    got = {tuple(r) for r in documents_queries.p9_found(spark, data).collect()}
    size = {i: 40 if t and "㐀" <= t[0][0] <= "鿿" else 20 for i, t in items.items()}
    runs = defaultdict(set)
    for i, t in items.items():
        for k in range(len(t) - size[i] + 1):
            runs[tuple(t[k : k + size[i]])].add(i)
    exact = {(d, i) for d, t in docs.items() for n in (20, 40) for k in range(len(t) - n + 1) for i in runs.get(tuple(t[k : k + n]), ()) if size[i] == n}
    assert exact and exact <= got
    for d, i in got:
        in_item = set(zip(items[i], items[i][1:], items[i][2:]))
        hits = [x in in_item for x in zip(docs[d], docs[d][1:], docs[d][2:])]
        assert max(sum(hits[k : k + size[i]]) for k in range(max(1, len(hits) - size[i] + 1))) >= size[i] / 2, (d, i)
