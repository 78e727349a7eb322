"""Column -> Column building blocks; everything stays inside Catalyst unless stated."""
