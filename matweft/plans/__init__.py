"""The registered queries of the matrix operators, each with its SQL."""
