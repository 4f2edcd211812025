"""Toxicity, URL rules and packing against plain re-computations; long texts and clashing names."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import exact_dedup, mixing, packing, quality, shingle_join, tokens, toxicity, urls

SMALL = "/root/testdata/sf0.01"


def plain_toxicity(rows, labels):
    """Scores by identifier and text, from the same rules over Python lists. The bounds aren't reached here."""
    held = lambda i: i is None or zlib.crc32(str(i).encode()) % 4 == 2
    marks = defaultdict(int)
    for i, y in labels:
        if y is not None and not held(i):
            marks[i] = max(marks[i], y)
    distinct = {(i, t or "") for i, t in rows}
    known = [(t, marks[i]) for i, t in distinct if i in marks]
    n = Counter(y for _, y in known)
    seen = defaultdict(lambda: [0, 0])
    for t, y in known:
        for term in {x for w in toxicity.distinct_words(t) for x in toxicity.terms_of(w)}:
            seen[term][y] += 1
    odds = [(t, c[1] / n[1] / ((c[0] + 0.5) / n[0]), c[1]) for t, c in seen.items() if c[1] >= toxicity.LEAST_TEXTS]
    odds = sorted((x for x in odds if x[1] >= toxicity.LEAST_ODDS), key=lambda x: (-x[2], -x[1], x[0]))[: toxicity.TERMS]
    voters = toxicity.voters_from([(t, o) for t, o, _ in odds])
    at = {t: k for k, (t, *_) in enumerate(odds)}
    mask = lambda t: voters.mask(toxicity.distinct_words(t))
    features = lambda t: sorted(at[x] for w in toxicity.distinct_words(t) for x in toxicity.terms_of(w) if x in at)
    start, sums = np.full((voters.count, 2), 1.0), np.array([2.0, 2.0])
    for t, y in known:
        start[:, y] += toxicity.bits(np.array([mask(t)]), voters.count)[0]
        sums[y] += 1
    patterns = sorted(Counter(mask(t) for _, t in rows).items())
    masks, counts = (np.array(c) for c in zip(*patterns))
    model = toxicity.fit_label_model(masks, counts.astype(float), voters.count, np.clip(start / sums, 1e-4, 1 - 1e-4), sums[1] / sums.sum())
    train = [t for i, t in distinct if not held(i)]
    target = model.posterior(toxicity.bits(np.array([mask(t) for t in train]), voters.count))
    weights, bias = toxicity.fit_linear([features(t) for t in train], target, len(at))
    return {(i, t or ""): (held(i) and i is not None, 1 / (1 + np.exp(-(bias + sum(weights[f] for f in features(t)))))) for i, t in rows}


def test_toxicity_as_in_plain_python(spark):
    rng = random.Random(3)
    bad = ["vile", "scumbag", "moronic", "trashy", "hateful", "scum"]
    rows, labels = [], []
    for i in range(500):
        toxic = i % 6 == 0
        words = [rng.choice([f"w{rng.randint(0, 600)}", f"“W{rng.randint(0, 99)},”"]) for _ in range(30)] + (rng.sample(bad, 3) if toxic else [])
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels += [(i, int(toxic))] * (1 + i % 2)
    rows += [(7, rows[7][1]), (7, "another text of seven vile"), (900, None), (901, ""), (None, "vile scumbag trashy moronic"), (902, "vile " * 300_000)]
    labels += [(8, None), (12, 0), (None, 1), (5_000, 1)]
    df = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, tie int, mask int, features int").repartition(5)
    got = toxicity.toxicity(df, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    want = plain_toxicity(rows, labels)
    text = defaultdict(list)
    for i, t in rows:
        text[i].append(want[i, t or ""])
    assert len(got) == len(rows)
    for i, found in text.items():
        mine = sorted((r.held_out, r.score) for r in got if r.doc_id == i)
        assert [m[0] for m in mine] == [f[0] for f in sorted(found)] and np.allclose([m[1] for m in mine], [f[1] for f in sorted(found)], atol=1e-6)
    assert all(r.predicted == (r.score >= 0.3) for r in got)


def plain_url(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        k = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:k])
        path = rest[k:]
        path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
    best = None
    for verdict, h, p in urls.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return host, path, best and best[0], best and best[1]


def test_urls_as_in_plain_python(spark):
    rng = random.Random(6)
    made = ["://", "a://b://c.org/es/", "x://EXAMPLE.org/es/?q", "x://a.example.org/en/1#/", "x://com", "x://com/fr/" + "y" * 200_000, "é://é.COM/de/1", "x:/y", "\n://org/\n", "x://org" + "/" * 5000]
    made += ["".join(rng.choice(["http", "://", "/", "?", "#", "org", "com", ".", "example", "/es/", "/en/1", "/fr/", "/de/", "A"]) for _ in range(rng.randint(1, 9))) for _ in range(600)]
    pages = spark.read.parquet(f"{SMALL}/pages.parquet").select("url")
    rows = [r.url for r in pages.collect()] + made + made[:5] + [None, None, ""]
    df = spark.createDataFrame([(i, u, "h", "p", 1.0) for i, u in enumerate(rows)], "page_id long, url string, host string, _url string, _label double").repartition(6)
    got = {r.page_id: r for r in urls.judged(df).collect()}
    assert sorted(got) == list(range(len(rows)))
    for i, u in enumerate(rows):
        host, path, rule, verdict = plain_url(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), u
        assert got[i].verdict == (verdict or ("block" if got[i].score >= 0.5 else "allow")), u
    same = defaultdict(set)
    for i, u in enumerate(rows):
        same[u].add((got[i].verdict, got[i].score))
    assert all(len(v) == 1 for v in same.values())


def plain_windows(docs, window, limit, least_cut):
    """Windows as lists of (doc, start, length): full ones as they come, then the open ones."""
    out, free = [], []  # open windows: [room, age, pieces]
    age = 0
    for doc, n in docs:
        start = 0
        while n >= window:
            out.append([(doc, start, window)])
            start, n = start + window, n - window
        while n:
            fit = min((w for w in free if w[0] >= n), key=lambda w: w[:2], default=None)
            if fit is None and len(free) < limit:
                age += 1
                fit = [window, age, []]
                free.append(fit)
            take = n
            if fit is None:
                fit = min(free, key=lambda w: w[:2])
                if fit[0] < least_cut or n - fit[0] < least_cut:
                    free.remove(fit)
                    out.append(fit[2])
                    continue
                take = fit[0]
            fit[2].append((doc, start, take))
            fit[0] -= take
            start, n = start + take, n - take
            if not fit[0]:
                free.remove(fit)
                out.append(fit[2])
    return out, sorted(free, key=lambda w: w[:2])


@pytest.mark.parametrize("window,limit,least_cut", [(16, 3, 2), (64, 5, 1), (100, 1, 30), (7, 2, 8)])
def test_packing_as_in_plain_python(window, limit, least_cut):
    rng = random.Random(window)
    docs = [(i, rng.choice([rng.randint(1, window), rng.randint(1, 3 * window), window])) for i in range(400)]
    ids = {d: np.arange(n, dtype=np.uint32) + 1000 * d for d, n in docs}
    packer = packing.OpenWindows(window, limit, least_cut)
    shape = lambda w: [(d, s, len(x)) for d, s, x, _ in w]
    got = []
    for d, n in docs:
        for w in packer.add(d, 0, ids[d], n):
            assert all((x == ids[d_][s : s + len(x)]).all() for d_, s, x, _ in w)
            got.append(shape(w))
    full, left = plain_windows(docs, window, limit, least_cut)
    assert got == full and [shape(w) for w in packer.rest()] == [w[2] for w in left]
    assert [sum(len(x) for *_, x, _ in w) for w in packing.joined(packer.rest(), window)][:-1] == [window] * max(0, -(-sum(window - w[0] for w in left) // window) - 1)


def test_a_tokenizer_of_another_kind_is_the_librarys_work(tmp_path):
    import json

    with open(tokens.tokenizer_path(), encoding="utf-8") as f:
        spec = json.load(f)
    spec["pre_tokenizer"]["add_prefix_space"] = True
    path = f"{tmp_path}/other.json"
    with open(path, "w", encoding="utf-8") as f:
        json.dump(spec, f)
    from tokenizers import Tokenizer

    e, library = tokens.Encoder(path), Tokenizer.from_file(path)
    texts = ["one two", "", "  x\ny", "é"]
    assert not e.by_words and tokens.Encoder(tokens.tokenizer_path()).by_words
    assert [x.tolist() for x in e.encode_all(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_callers_columns_keep_their_values(spark):
    names = ["_row", "_df", "_tie", "_size", "_words", "_take", "_kept", "key", "label", "node", "first", "_run"]
    texts = ["a b c d e f g h i j k", "one two three four five six seven eight nine ten eleven", None, ""]
    rows = [(i, texts[i % 4], f"s{i % 2}", *[f"{n}{i}" for n in names]) for i in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names)).repartition(3)
    own = {r[0]: r[2:] for r in rows}
    for out in (quality.quality_filter(df), exact_dedup.drop_duplicates(df), shingle_join.one_of_each(df), mixing.mixed_documents(df)):
        got = out.collect()
        assert out.columns == df.columns and got
        assert all(tuple(r)[2:] == own[r.doc_id] for r in got)


def test_sources_of_alike_rows_stay_apart(spark):
    rows = [(1, "a b c", "s"), (1, "a b c", "t"), (1, "a b c", None), (1, "a b c", "s")]
    out = mixing.mixed_documents(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    taken = Counter()
    for r in out.collect():
        taken[r.source] += len(r.text.split())
    want = Counter()
    for r in mixing.mixture(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect():
        want[r.source] += r.taken
    assert taken == +want and set(taken) == {"s", "t", None}


def test_which_of_alike_rows_stays_does_not_depend_on_partitions(spark):
    rows = [(5, f"a  b{' ' * (i % 3)}c", "s", i) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n int")
    found = [tuple(f(df.repartition(p, "n")).first()) for f in (exact_dedup.drop_duplicates,) for p in (1, 3, 7)]
    assert len(set(found)) == 1
    assert F is not None
