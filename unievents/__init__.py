"""unievents: event discovery and interest-based recommendation as Spark batch jobs.

Layout:
  sources/    table bindings and file readers/writers (IO1-IO7)
  functions/  column expressions: text, dates, prices, JSON recovery (P1, P5, D1-D10, M1)
  operators/  DataFrame -> DataFrame operators (F*, J*, G*, S*, P*, M*, W*)
  plans/      composite queries (R1-R11) and the query registry
  streaming/  Structured Streaming form of the page jobs
"""

__version__ = "0.1.0"
