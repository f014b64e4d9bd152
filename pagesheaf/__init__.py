"""pagesheaf: page corpora to clean Markdown as Spark DataFrame operators."""

__version__ = "0.1.0"
