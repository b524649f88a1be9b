"""Every order is a case, against plain Python over a small table."""

from __future__ import annotations

import collections

from tidemark.plans import evaluation


def test_every_order_is_a_case(spark, tmp_path):
    keys = [1, 7, 11, 13, 37, 74, 399, 400, 401, 407, 418, 420, 425, 429, 434, 437, 444, 481, 5000, 123_457]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey bigint").write.parquet(f"{tmp_path}/orders.parquet")
    name = lambda k: "c0" if k % 37 == 0 else f"c{k}"
    copies = collections.Counter(map(name, keys))
    keyed = {f"c{k}": k for k in keys if k % 11}

    def problem(k):
        a = keyed.get(name(k))
        if k % 13 == 0:
            return "symbol_empty"
        if k % 17 == 0:
            return "n_bars_not_positive"
        if a is None:
            return "answer_missing"
        if a % 7 == 0:
            return "analysis_mode_unknown"
        if a % 3 == 0 and a % 6:
            return "retrospective_direction"
        if a % 3 and a % 6 == 0:
            return "forward_direction"
        return "ground_truth_empty" if a % 19 == 0 else "case_id_repeated" if copies[name(k)] > 1 else None

    got = evaluation.b15_case_problems(spark, str(tmp_path)).collect()
    assert collections.Counter((r.case_id, r.problem) for r in got) == collections.Counter((name(k), problem(k)) for k in keys)
