"""gleaner: evidence retrieval over conversational records, expressed as Spark plans."""

__version__ = "0.1.0"
