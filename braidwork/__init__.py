"""braidwork: a Spark-native engine for explainable links between news stories and companies."""

__version__ = "0.1.0"
