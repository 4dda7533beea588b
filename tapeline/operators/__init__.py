"""Relational operators: DataFrame in, DataFrame out; nothing here runs an action unless its docstring says so."""
