"""Orrery: nearest-neighbour analytics over vectors and JSON payloads, as Spark DataFrame plans."""
