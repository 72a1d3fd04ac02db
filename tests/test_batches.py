from hashlib import md5

import __spark_entry__ as entry


def test_all_rows_are_packed_and_requested(spark, tmp_path):
    """More rows than the sample of batch_pack and batch_requests has."""
    n = 1203
    text = lambda k: None if k % 50 == 0 else f'say "{k}"'
    spark.createDataFrame([(k, text(k), f"o{k}") for k in range(1, n + 1)], "row_id long, instruction string, output string").write.parquet(f"{tmp_path}/train.parquet")
    ids = sorted(range(1, n + 1), key=lambda k: (md5(f"42:{k}".encode()).hexdigest(), k))
    batches = {b: ids[5 * b : 5 * b + 5] for b in range(3, -(-n // 5))}
    packed = entry.queries()["batch_pack_all"](spark, str(tmp_path)).collect()
    assert {r.batch: (r.n_rows, r.rows) for r in packed} == {b: (len(x), ",".join(map(str, x))) for b, x in batches.items()} and len(packed) == len(batches)
    asked = entry.queries()["batch_requests_all"](spark, str(tmp_path)).collect()
    want = {b: (len(x), sum(range(len(x))), md5("|".join(text(k) or "" for k in x).encode()).hexdigest()) for b, x in batches.items()}
    assert {r.batch: (r.n_rows, r.id_sum, r.instructions) for r in asked} == want and len(asked) == len(batches)
