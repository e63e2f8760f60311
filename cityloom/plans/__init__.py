"""End-to-end plans: panel assembly, land cover, modelling, and the checked query catalogue."""
