import numpy as np

from gzframe.llm.vector_dedup import near_vectors, plan_for, windows


def brute(rows, least):
    usable = [(i, v) for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n = len(rows)
    links, parent = [set() for _ in range(n)], list(range(n))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, (i, v) in enumerate(usable):
        for j, w in usable[:a]:
            if len(v) == len(w) and np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w) >= least:
                links[i].add(j)
                links[j].add(i)
                parent[max(top(i), top(j))] = min(top(i), top(j))
    small = {}
    for i in range(n):
        small[top(i)] = min(small.get(top(i), rows[i][0]), rows[i][0])
    return sorted((rows[i][0], len(links[i]), small[top(i)]) for i in range(n))


def table(rng, dims=32):
    rows, k = [], 0
    for g in range(120):
        base = rng.standard_normal(dims)
        for _ in range(40 if g == 0 else rng.integers(1, 5)):
            v = base + rng.standard_normal(dims) * rng.choice([0.0, 0.05, 0.15])
            rows.append((k * 7 % 1009, [float(x) for x in np.float32(v)]))
            k += 1
    return [*rows, (5001, None), (5002, []), (5003, [0.0] * dims), (5004, [1.0, None]), (5005, [float("nan")] * dims), (5006, [1.0, 2.0]), (5007, [2.0, 4.0])]


def test_recall_and_no_false_links(spark):
    rows = table(np.random.default_rng(4))
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), cell=60).collect())
    want = brute(rows, 0.9)
    assert [g[0] for g in got] == [w[0] for w in want]
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    assert sum(g[1] for g in got) >= 0.95 * sum(w[1] for w in want)
    assert [g for g in got if g[0] > 5000] == [w for w in want if w[0] > 5000]


def test_kept_is_the_smallest_and_empty(spark):
    frame = spark.createDataFrame([(3, [1.0, 0.0]), (1, [2.0, 0.01]), (2, [0.0, 1.0]), (None, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors(frame).collect()}
    assert got == {1: (1, 1, True), 3: (1, 1, False), 2: (0, 2, True), None: (0, None, True)}
    assert near_vectors(frame.limit(0)).count() == 0


def test_recall_at_default_settings_over_many_cells(spark):
    # some 9,000 vectors: neighbours at all angles about the least one, a dense group, and exact copies
    rng, rows = np.random.default_rng(7), []
    for g in range(3000):
        base = rng.standard_normal(64)
        base /= np.linalg.norm(base)
        for _ in range(400 if g == 0 else 2):
            side = rng.standard_normal(64)
            side -= side @ base * base
            cos = rng.uniform(0.9, 0.97)
            rows.append(base * cos + side / np.linalg.norm(side) * np.sqrt(1 - cos * cos))
        rows.append(base)
        if g % 10 == 0:
            rows += [base] * 3
    x = np.float32(rows)
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    links = np.concatenate([(unit[i : i + 1000] @ unit.T >= 0.9).sum(axis=1) - 1 for i in range(0, len(unit), 1000)])
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in near_vectors(frame).collect()}
    assert len(got) == len(x) and all(got[i].n_links <= n for i, n in enumerate(links))
    assert sum(r.n_links for r in got.values()) >= 0.96 * links.sum()
    # dense cells cut into blocks give the same
    again = {r.vec_id: r for r in near_vectors(frame, block=100).collect()}
    assert again == got


def test_depth_grows_and_tables_keep_recall():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    plans = [plan_for(x, n, 0.9, 0.02, 1000, 4) for n in (1000, 10_000, 100_000)]
    assert [p.depth for p in plans] == [0, 4, 7] and plans[0].tables == 1 < plans[1].tables < plans[2].tables
    side = rng.standard_normal(x.shape)
    side -= (side * x).sum(axis=1, keepdims=True) * x
    y = 0.9 * x + np.sqrt(0.19) * side / np.linalg.norm(side, axis=1, keepdims=True)
    for p in plans:
        assert (p.codes(x) == p.codes(y)).any(axis=1).mean() > 0.95


def test_windows_miss_few():
    first, further, need = windows(0.9, 64, 12)
    assert 0 < further < first and 4 <= need <= 11
