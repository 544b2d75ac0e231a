"""Layout-graph field extraction expressed as DataFrame operators."""
