"""slatewright: session-based recommendation analytics as Spark jobs.

Every operator takes DataFrames and returns a DataFrame.  Nothing is executed
until the caller runs an action, except where a docstring says otherwise (k-core
rounds and the few scalar look-ups that choose between two physical strategies).
"""

__version__ = "0.1.0"
