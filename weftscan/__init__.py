"""weftscan: web-evidence analytics as DataFrame plans on Apache Spark."""

__version__ = "0.1.0"
