"""Functions that build columns, by family. Names that Python reserves end in an underscore."""

from tessera.functions import aggregates, arrays, conditional, conversion, geo, hashing, jsons, maths, predicates, strings, times, windows

__all__ = ["aggregates", "arrays", "conditional", "conversion", "geo", "hashing", "jsons", "maths", "predicates", "strings", "times", "windows"]
