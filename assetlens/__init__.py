"""assetlens: asset reliability analytics (maintenance, production, emissions) on Spark."""

__version__ = "0.1.0"
