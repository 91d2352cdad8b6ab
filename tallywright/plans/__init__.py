"""Query plans over the test tables and orchestration of operators."""
