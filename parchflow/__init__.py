"""parchflow: document analytics over page, block, word and link tables, as Spark plans."""

__version__ = "0.1.0"
