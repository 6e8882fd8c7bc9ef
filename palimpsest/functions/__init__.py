"""Scalar functions: text.py holds JVM-side expressions, code.py and diff.py the Arrow-batched Python ones."""
