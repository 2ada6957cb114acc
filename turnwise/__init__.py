"""turnwise: a Spark-native analytics engine for diarized speech transcripts."""

__version__ = "0.1.0"
