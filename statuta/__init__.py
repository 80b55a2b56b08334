"""Analytics over regulatory text and compliance registers, as PySpark DataFrame operators."""
