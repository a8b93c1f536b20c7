"""Simulation steps and registered queries, composed of the operators."""
