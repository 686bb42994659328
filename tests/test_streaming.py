"""Incremental landing: two exports arrive, both are landed once."""

import os

from tallyspark.streaming import land_exports


def test_land_exports(spark, tmpdir_path):
    inbox = os.path.join(tmpdir_path, "inbox")
    os.makedirs(inbox)
    for i in range(2):
        with open(os.path.join(inbox, f"export{i}.csv"), "w") as fh:
            fh.write("Creditore;Importo fattura\n" + f"R{i};1,50\nS{i};2,00\n")
    out = os.path.join(tmpdir_path, "landed")
    q = land_exports(spark, inbox, os.path.join(inbox, "export0.csv"), out)
    q.awaitTermination(120)
    df = spark.read.parquet(out)
    assert df.count() == 4 and sorted(df.columns)[:2] == ["Creditore", "Importo fattura"]
    q2 = land_exports(spark, inbox, os.path.join(inbox, "export0.csv"), out)
    q2.awaitTermination(120)
    assert spark.read.parquet(out).count() == 4  # nothing landed twice
