"""Training-data operators: ten corpus components, each usable on any DataFrame."""
