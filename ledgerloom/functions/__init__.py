"""Column functions: text normalisation, identities, geometry and small scalars."""
