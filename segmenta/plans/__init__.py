"""Plans: the dashboard cards wired from source tables to operators."""
