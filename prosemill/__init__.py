"""prosemill: prose analytics on Spark DataFrames.

Documents become ``blocks`` and ``sentences`` tables; rules are DataFrame plans
over those tables; findings feed reports, calibration and revision comparison.
The subpackage ``llm`` holds training-data operators and is optional: nothing
outside it imports it.
"""

__version__ = "0.1.0"
