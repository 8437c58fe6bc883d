"""Training-data operators: each module is one operator with its own general interface.

Conventions shared by all of them
  * columns are chosen by name and every other column of the input is ignored, so clashing
    extra columns can never shadow an internal one;
  * a null text is an empty text; a null id is an ordinary value that equals other nulls;
  * repeated rows are separate rows unless an operator's docstring says otherwise;
  * an empty table gives an empty result with the same schema.
"""
