"""quern: temporal document-graph analytics and retrieval evaluation, expressed as Spark DataFrame plans."""

__version__ = "0.1.0"
