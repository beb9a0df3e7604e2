from kinship import registry


def test_training_reads_stored_rows(spark):
    """Training passes over its rows many times, which must not join and rank them anew each time."""
    files = registry._train_pairs(spark, "/root/testdata/sf0.001").inputFiles()
    assert files and all("/training-" in f for f in files)
