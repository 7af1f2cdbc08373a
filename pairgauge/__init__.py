"""pairgauge: profile many labelled tables on Spark and compare two modelling pipelines on them."""

__version__ = "0.1.0"
