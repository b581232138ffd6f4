"""newsloom: the data side of a personalised news platform as Spark jobs.

Every operator takes DataFrames (or columns) and returns DataFrames (or
columns); nothing here runs an action except the streaming starters and the
explicit writers.
"""

__version__ = "0.1.0"
