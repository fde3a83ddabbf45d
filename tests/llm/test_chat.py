import random

from storelens.llm import chat as C

SCHEMA = "conv_id long, turn long, role string, text string, part string, n_turns string, `__k` string, `__pos` string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA).repartition(3)


def brute(rows):
    convs = {}
    for c, turn, role, text in set(rows):
        convs.setdefault(c, []).append((turn, role or "", text or ""))
    convs = {c: tuple(t[1:] for t in sorted(ts)) for c, ts in convs.items()}
    proper = {ts[:k] for ts in convs.values() for k in range(1, len(ts))}
    kept = {}
    for c, ts in convs.items():
        if ts not in proper:
            kept[ts] = min(kept.get(ts, c), c)
    out = []
    for ts, c in kept.items():
        text = "".join(f"<|{r}|>\n{t.replace('<|', '< |')}<|end|>\n" for r, t in ts)
        out.append((c, len(ts), len(text), text))
    return sorted(out)


def check(spark, rows):
    got = C.render(frame(spark, rows)).collect()
    assert all(r.part == 0 for r in got)
    assert sorted((r.conv_id, r.n_turns, r.n_chars, r.text) for r in got) == brute(rows)


def test_equals_brute_force(spark):
    rng = random.Random(1)
    rows, conv = [], 0
    for _ in range(40):
        turns = [(rng.choice(["user", "assistant", None]), f"t{rng.randint(0, 3)} <|x|>") for _ in range(rng.randint(1, 9))]
        for _ in range(rng.randint(1, 4)):  # snapshots, some equal, numbered from anywhere
            first, n = rng.randint(0, 5), rng.randint(1, len(turns))
            rows += [(conv, first + 2 * i, *t) for i, t in enumerate(turns[:n])]
            conv += 1
    check(spark, rows + rows[:30])  # repeated rows


def test_snapshots_collapse(spark):
    a = [(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "assistant", "yo"), (3, 0, "user", "hi"), (3, 1, "assistant", "yo")]
    got = C.render(frame(spark, a)).collect()
    assert [(r.conv_id, r.text) for r in got] == [(2, "<|user|>\nhi<|end|>\n<|assistant|>\nyo<|end|>\n")]


def test_long_conversations_come_in_parts(spark, monkeypatch):
    rows = [(7, i, "user", f"t{i}") for i in range(1000)] + [(8, i, "user", f"t{i}") for i in range(600)]
    got = C.render(frame(spark, rows)).orderBy("part").collect()
    assert [r.part for r in got] == [0, 1, 2, 3] and {r.conv_id for r in got} == {7} and {r.n_turns for r in got} == {1000}
    assert "".join(r.text for r in got) == "".join(f"<|user|>\nt{i}<|end|>\n" for i in range(1000))


def test_nulls_and_empty_table(spark):
    assert C.render(frame(spark, [])).collect() == []
    got = C.render(frame(spark, [(None, None, None, None), (None, 1, "user", ""), (4, 0, "user", "z")])).collect()
    assert {(r.conv_id, r.text) for r in got} == {(None, "<||>\n<|end|>\n<|user|>\n<|end|>\n"), (4, "<|user|>\nz<|end|>\n")}


def test_main_path_is_native(spark):
    plan = C.render(frame(spark, [(1, 0, "user", "hi")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Cartesian" not in plan
