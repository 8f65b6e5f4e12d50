"""A PySpark-native engine for frequent-subgraph mining in one large labelled graph."""
