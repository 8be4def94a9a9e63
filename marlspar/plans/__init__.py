"""The dialect's front end (tokens, syntax trees, parser) and the builder of DataFrame plans."""
