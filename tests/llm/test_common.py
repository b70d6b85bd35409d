import pytest
from pyspark.sql import functions as F

from vacantia import session
from vacantia.llm import common, jpeg, simhash


def test_results_never_share_a_name_with_a_column(docs):
    with pytest.raises(ValueError, match="fp"):
        simhash.with_fingerprints(docs.withColumn("FP", F.lit(1)))
    with pytest.raises(ValueError, match="media"):
        jpeg.with_media(docs.withColumn("media", F.lit(1)))
    with pytest.raises(ValueError, match="feature"):
        jpeg.decoded(docs.withColumn("media", F.lit(None).cast("binary")))


def test_work_folder(spark):
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert session.work_dir(spark) == shared
    path = common.stored(spark.range(3), "kept").inputFiles()[0]
    assert f"{shared}/kept-" in path
