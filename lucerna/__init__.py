"""lucerna: a Spark-first engine for auditable retrieval-and-verification analytics.

Operators are functions from DataFrame to DataFrame; nothing here keeps global state
beyond the active session.  The training-data operators live in ``lucerna.llm``, which
no other module of the library imports.
"""

__version__ = "0.1.0"
