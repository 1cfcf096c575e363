"""Plans: what runs end to end over the published tables."""
