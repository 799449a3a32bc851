"""How positions and windows over a whole sequence stay distributed."""
