"""What has to stay out of the driver, and plans that must not grow with their own length."""

from tidewater.operators import assemble
from tidewater.plans import extraction


def plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString(), frame._jdf.queryExecution().executedPlan().toString()


def odd_cells(spark):
    grid = {
        1: [["A", "A", None, "B"], [" 1 ", "yes", "", None], [" ", "", None, ""], ["2", None, None, "x"]],
        2: [["alone"]],
        3: [["", " "], ["7"], [None, "8", "wider"]],
        4: [["a", "b"], [" ", ""]],
    }
    rows = [(t, i, j, x) for t, lines in grid.items() for i, line in enumerate(lines) for j, x in enumerate(line)]
    return spark.createDataFrame([*rows, (5, 1, 0, "no header"), (5, 2, 0, "x"), (1, 3, 2, "late")], "table_no long, row_no long, col_no int, text string").filter("NOT (table_no = 1 AND row_no = 3 AND col_no = 2 AND text IS NULL)")


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def test_data_cells_are_those_of_the_chain(spark):
    cells = odd_cells(spark)
    for first in (1, 2):
        chain = cells.transform(assemble.whole_tables).transform(assemble.padded).transform(lambda c, n=first: assemble.promoted(c, n)).transform(assemble.normalised)
        assert rows(assemble.data_cells(cells, first).select(chain.columns)) == rows(chain)
        assert rows(assemble.typed_tables(cells, first)) == rows(assemble.column_types(chain).drop("decimal", "formats"))


def test_types_of_tables_scan_their_cells_a_few_times_and_broadcast_nothing(spark, tmp_path):
    odd_cells(spark).write.parquet(str(tmp_path / "cells"))
    cells = spark.read.parquet(str(tmp_path / "cells"))
    made, run = plan(assemble.typed_tables(cells))
    assert made.count("Relation ") <= 6 and "Broadcast" not in run  # 36 scans, and hash tables of rows and columns, before


def test_padding_joins_tables_alone(spark, tmp_path):
    odd_cells(spark).write.parquet(str(tmp_path / "cells"))
    made, run = plan(assemble.promoted(assemble.padded(spark.read.parquet(str(tmp_path / "cells")))))
    assert made.count("Relation ") <= 4 and "Broadcast" not in run


def test_many_small_tables_are_read_by_few_tasks(spark, tmp_path):
    spark.range(80).selectExpr("id AS table_no", "id * 2 AS v").write.partitionBy("table_no").parquet(str(tmp_path / "t" / "s"))
    before = spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism")
    found = extraction.loaded_tables(spark, str(tmp_path / "t"), "s")
    tasks = spark.sparkContext.defaultParallelism * 4
    assert found.rdd.getNumPartitions() <= tasks and rows(found.selectExpr("table_no", "v")) == sorted(((i, 2 * i) for i in range(80)), key=str)
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == before
