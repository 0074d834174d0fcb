"""End-to-end audit and the registered queries."""
