"""upliftforge: randomized-experiment (uplift) analytics expressed as PySpark plans."""
