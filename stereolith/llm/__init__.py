"""Training-data operators: one module an operator, one query each (``stereolith.llm.queries``)."""
