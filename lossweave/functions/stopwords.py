"""Stop words of the keyword tokenizer. Every operator takes the set as a parameter."""

# Spark's English stop words of three or more letters.
ENGLISH = frozenset(
    """
    about above after again against all and any are because been before being below between both but can cannot
    could did does doing don down during each few for from further had has have having her here hers herself him
    himself his how into its itself just more most myself nor not now off once only other ought our ours ourselves
    out over own same she should some such than that the their theirs them themselves then there these they this
    those through too under until very was were what when where which while who whom why will with would you your
    yours yourself yourselves
    """.split()
)

# German function words.
GERMAN = frozenset(
    """
    aber als am an auch auf aus bei bin bis da das dem den der des die ein eine einem einen einer es für hat im in
    ist mit nach nicht oder sich und von war zu zum zur
    """.split()
)

# Words of the field labels and their German counterparts.
FIELD_WORDS = frozenset(
    """
    business cause claim country damage damaged description line loss object type
    anspruch beschreibung schaden schäden
    """.split()
)

STOP_WORDS = ENGLISH | GERMAN | FIELD_WORDS
