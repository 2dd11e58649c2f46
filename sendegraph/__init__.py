"""sendegraph: PySpark-native mining of structured knowledge from episodic broadcasts."""

__version__ = "0.1.0"
