"""weftline: a Spark-native engine for acquiring, cleaning and analysing web records."""

__version__ = "0.1.0"
