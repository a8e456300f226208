"""Graph operators over solutions."""
