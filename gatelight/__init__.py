"""gatelight: record conformance and block statistics as Spark DataFrame programs."""
