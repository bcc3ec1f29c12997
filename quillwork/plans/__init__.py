"""Registered queries and the views of the driver tables that they run on."""
