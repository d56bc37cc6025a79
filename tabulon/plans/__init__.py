"""Plan building blocks: cut lineage, dense positions, windows over ordered blocks."""
