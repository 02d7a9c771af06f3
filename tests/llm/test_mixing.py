import os
import random

import pytest

from stylograph.llm import mixing as M
from stylograph.llm.tokenize import VOCABULARY


def test_schedule_keeps_within_a_block():
    need = {"a": 5000, "b": 3333, "c": 1667}
    block, done = 100, dict.fromkeys(need, 0)
    order = M.schedule(need, block)
    assert len(order) == len(set(order)) == sum(-(-n // block) for n in need.values())
    for slot, (s, i) in enumerate(order[:100], 1):
        assert i == done[s]
        done[s] += 1
        for x, n in need.items():
            assert abs(done[x] - slot * n / sum(need.values())) < 1 + 1e-9


def test_cycles_make_one_schedule_less_than_two_quanta_off():
    lay = M.layout({"a": 900_000, "b": 70_001, "c": 1_234, "d": 333_333}, 10, {"a": (0.6, 1), "b": (0.3, 9), "c": (0.001, 2), "d": (0.099, 1)}, block=300, cycle=64)
    done, total, slots = dict.fromkeys(lay.need, 0), sum(lay.need.values()), 0
    for c in range(lay.cycles):
        for s, i, slot in M.turns_of(lay, c):
            assert i == done[s] and slot == slots
            done[s] += 1
            slots += 1
            assert all(abs(done[x] - slots * n / total) < 2 for x, n in lay.need.items())
    assert lay.cycles > 10 and all(done[s] * lay.quantum >= n for s, n in lay.need.items())


def test_plan():
    assert M.plan({"a": 100, "b": 1000}, {"a": (0.5, 3), "b": (0.5, 1), "none": (0.2, 1)}) == {"a": 300, "b": 300}
    assert M.plan({"a": 0}, {"a": (1.0, 1)}) == {} and M.plan({"a": 10}, {"a": (0.0, 1)}) == {}
    assert M.layout({}, 0, {"a": (1.0, 1)}) is None
    assert M.layout({"a": 10**13, "b": 10**13}, 9000, {"a": (0.5, 1), "b": (0.5, 1)}).block == M.BLOCK  # it does not grow with the corpus


@pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary here")
def test_operator(spark):
    docs = [(i, "slovo " * (1 + i % 5), "big" if i % 4 else "small", "x") for i in range(400)] + [(1000, None, "big", "x"), (1001, "a", None, "x"), (1002, "a", "alien", "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, slot string")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.4, 3), ("gone", 0.1, 2)], "source string, target_share double, max_repeats int")
    made = M.mix(df, targets, block=64).collect()
    assert {r.source for r in made} == {"big", "small"}
    uses = {}
    for r in made:
        uses.setdefault(r.doc_id, []).append(r.copy)
    cap = {r.doc_id: 1 if r.source == "big" else 3 for r in made}
    assert all(sorted(v) == list(range(1, len(v) + 1)) and len(v) <= cap[k] for k, v in uses.items())
    sized = M.sized(df, targets)
    rows = {r.source: r for r in M.shares(M.mix(df, targets, block=64), targets, sized).collect()}
    assert abs(rows["big"].actual_share - 5 / 9) < 0.02 and abs(rows["small"].actual_share - 4 / 9) < 0.02 and rows["gone"].actual_share == 0
    held = {r.source: r.n for r in sized.groupBy("source").sum("n_tokens").toDF("source", "n").collect()}
    assert all(rows[s].n_left_out == held[s] - sum(r.n_tokens for r in made if r.source == s and r.copy == 1) for s in held) and rows["gone"].n_left_out == 0
    assert M.mix(df.limit(0), targets).count() == 0 and M.mix(df, targets.limit(0)).count() == 0


def test_no_source_is_a_block_off_at_any_document(spark):
    rng = random.Random(2)
    docs = [(i, rng.choice("aaaaaaaabbc"), rng.choice([1, 5, 30, 80, 400])) for i in range(6000)] + [(9000, "b", 900), (9001, "c", 901), (9001, "c", 901)]
    made = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.35, 2), ("c", 0.1, 4), ("d", 0.05, 1)], "source string, target_share double, max_repeats int")
    lay = M.layout_of(made, targets, 1000, 16)
    runs = []
    for bucket in (1_000_000, 100):
        rows = M.mix_sized(made, targets, 1000, cycle=16, bucket=bucket).orderBy("slot", "place", "doc_id").collect()
        done, placed, total, worst = dict.fromkeys(lay.need, 0), 0, sum(lay.need.values()), 0
        for r in rows:
            done[r.source] += r.n_tokens
            placed += r.n_tokens
            worst = max(worst, *(abs(done[s] - placed * n / total) for s, n in lay.need.items()))
        assert worst < lay.block
        runs.append((done, len(rows)))
        told = M.deviations(M.mix_sized(made, targets, 1000, cycle=16, bucket=bucket), lay).collect()
        assert {r.source for r in told} == set(lay.need) and all(max(r.most_ahead, r.most_behind) <= worst + 0.001 for r in told)
    assert lay.cycles > 10 and all(abs(runs[0][0][s] - lay.need[s]) <= 451 for s in lay.need)
