"""Keep, condense and hand out public technical conversations with Spark.

Every function takes and returns plain DataFrames.  The packages are

* ``sources``    reading chat-like tables, JSON exports and line logs; the archive writer
* ``operators``  preservation, selection, distillation, respect, consumption
* ``streaming``  the same intake and activity counts over live streams
* ``functions``  column expressions shared by the operators
* ``plans``      handling of hot keys, and two composed runs
"""
