from datetime import datetime as dt

import numpy as np

from stratacode.operators.orphans import orphan_references, pack, unpack

REL = "id long, source_function_id long, target_file_id long, target_function_name string, relationship_type string, created_at timestamp_ntz, extra string"
FN = "id long, name string, created_at timestamp_ntz, extra string"
FL = "id long, created_at timestamp_ntz"


def run(spark, rel, fn, fl):
    got = orphan_references(spark.createDataFrame(rel, REL), spark.createDataFrame(fn, FN), spark.createDataFrame(fl, FL)).collect()
    return sorted((r.relationship_id, r.ref_field, r.month) for r in got)


def test_missing_later_and_unknown_names(spark):
    t = dt(2030, 5, 10, 12)
    fn = [(1, "a", dt(2030, 1, 1), ""), (2, "b", dt(2030, 5, 10, 13), ""), (3, None, None, ""), (40000, "c", dt(2030, 6, 1), ""), (-5, "n", dt(2029, 1, 1), "")]
    rel = [
        (1, 1, 7, "a", "CALLS", t, ""),
        (2, 2, None, "zz", "calls", t, ""),
        (2, 2, None, "zz", "calls", t, ""),
        (3, 40000, 8, "A", "Calls", t, ""),
        (4, 99, 9, "zz", "IMPORTS", t, ""),
        (5, 3, None, None, "CALLS", t, ""),
        (6, 40000, None, "c", None, None, ""),
        (7, -5, None, "n", "CALLS", t, ""),
        (8, -6, None, "n", "CALLS", t, ""),
        (9, 0, None, "n", "CALLS", t, ""),
        (None, 99, None, "zz", "CALLS", t, ""),
    ]
    fl = [(7, dt(2030, 5, 10, 12)), (8, dt(2030, 5, 10, 12, 0, 1)), (8, dt(2030, 5, 11))]
    assert run(spark, rel, fn, fl) == [
        (2, "source_function_id", "2030-05"),
        (2, "target_function_name", "2030-05"),
        (3, "source_function_id", "2030-05"),
        (3, "target_file_id", "2030-05"),
        (3, "target_function_name", "2030-05"),
        (4, "source_function_id", "2030-05"),
        (4, "target_file_id", "2030-05"),
        (8, "source_function_id", "2030-05"),
        (9, "source_function_id", "2030-05"),
    ]


def test_empty_tables(spark):
    rel = [(1, 1, 1, "a", "CALLS", dt(2030, 1, 1), "")]
    assert len(run(spark, rel, [], [])) == 3
    assert run(spark, [], [(1, "a", None, "")], []) == []


def test_bitmaps_keep_their_positions():
    for n in (0, 1, 2047, 2048, 32768):
        at = np.random.default_rng(n).permutation(32768)[:n]
        packed = pack(at)
        assert np.array_equal(unpack(packed), np.sort(at)) and len(packed) <= min(1 + 2 * n, 4097)
