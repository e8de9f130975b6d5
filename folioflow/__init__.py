"""folioflow: a PySpark-native engine for document structure analytics.

The core packages (``functions``, ``operators``, ``sources``, ``plans``,
``streaming``) stand alone; ``folioflow.llm`` holds the training-data
operators and is imported by nothing else.
"""

__version__ = "0.1.0"
