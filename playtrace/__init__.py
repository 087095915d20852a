"""Analytics for game event logs, written as lazy Spark DataFrame operators.

Every operator takes a DataFrame and returns a DataFrame. Sub-packages:

* ``sources``   reading and writing CSV folders, the typed event view, split files
* ``functions`` column expressions (param text, ratios)
* ``operators`` the transformations and metrics
* ``plans``     compositions that run a whole folder
"""
