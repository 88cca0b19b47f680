from collections import defaultdict

from provenir.llm import mixing


def test_nasty(nasty):
    got = mixing.pareto_mix(nasty).collect()
    assert len(got) == nasty.count() and sorted(map(str, got)) == sorted(map(str, mixing.pareto_mix(nasty.repartition(5)).collect()))
    assert all(0 <= r.copies <= 3 and r.tie == "t" and r.group == "g" for r in got)
    assert {r.size for r in got if r.text is None} == {0}
    sizes = {r.source: (r.source_size, r.target) for r in got}
    assert abs(sum(t for _, t in sizes.values()) - sum(s for s, _ in sizes.values())) < 1e-6
    assert all(t <= 3 * s + 1e-9 for s, t in sizes.values())


def test_words_taken_come_near_targets(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 7919 % 90)), f"s{i % 5}" if i % 3 else "hot") for i in range(3000)]
    got = mixing.pareto_mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    taken, target, whole = defaultdict(int), {}, {}
    for r in got:
        taken[r.source] += r.copies * r.size
        target[r.source], whole[r.source] = r.target, max(whole.get(r.source, 0), r.size)
    assert all(abs(taken[s] - target[s]) <= whole[s] for s in target)
    weights = {s: i % 3 + 1 for i, s in enumerate(sorted(target))}
    free = [target[s] / weights[s] for s in target if target[s] < 2.999 * sum(r.size for r in got if r.source == s)]
    assert max(free) - min(free) < 1e-6


def test_importance_is_an_inclusion_weight(spark):
    rows = [(i, "w w w w", "a", 4.0 if i % 2 else 1.0) for i in range(400)] + [(1000 + i, "w w w w", "b", 1.0) for i in range(400)]
    got = mixing.pareto_mix(spark.createDataFrame(rows, "doc_id long, text string, source string, v double"), importance="v").where("source = 'a'").collect()
    heavy, light = (sum(r.copies for r in got if r.v == v) for v in (4.0, 1.0))
    assert heavy > 2 * light


def test_empty(empty):
    assert mixing.pareto_mix(empty).count() == 0
