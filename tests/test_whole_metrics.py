from sedimark.api import Engine


def test_all_exceeding_files_are_listed(spark, tmp_path):
    engine = Engine(spark, str(tmp_path))
    engine.chunks = lambda: spark.range(1101).selectExpr("concat('f', id, '.ts') as source", "int(200 + id) as end_line", "1 as lines_code")
    report = engine.code_metrics()
    assert len(report["exceeding_files"]) == report["summary"]["files_exceeding_threshold"] == 1101
    assert report["exceeding_files"][-1]["source"] == "f0.ts"
