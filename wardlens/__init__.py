"""wardlens: hospital cost and utilisation analytics as Spark DataFrame operators.

Every public operator takes DataFrames (plus a frozen parameter object) and
returns a DataFrame; nothing is collected to the driver.  Modules:

* ``sources``   -- readers for the warehouse tables and the driver test tables
* ``functions`` -- column-level helpers (exact ratios, text/date semantics,
                   bin specs, DRG ranges, chi-squared helpers)
* ``operators`` -- the analyses (opportunity, redundancy, entity_compare,
                   quality, contingency, benchmark, drg, cohort)
* ``plans``     -- named query plans wired onto the test tables and their
                   DuckDB oracle SQL
* ``streaming`` -- micro-batch adapter that applies the batch operators to a
                   stream of billing lines
"""

__version__ = "0.1.0"
