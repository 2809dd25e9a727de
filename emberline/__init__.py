"""A forensic timeline engine on Spark."""
