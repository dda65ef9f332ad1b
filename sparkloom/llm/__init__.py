"""Training-data operators: one module per operator, queries in :mod:`sparkloom.llm.catalog`."""
