"""procurelake: batch analytics over tender and bid documents on Spark."""

__version__ = "0.1.0"
