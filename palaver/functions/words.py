"""Own word lists. They are parameters of the views that use them."""

# Function words that word counts leave out.
STOPWORDS = "a about all also am an and any are as at be been but by can can't did do don't for from get go got had has have he her him his how i if in is it its it's just like me more my no not now of off on or our out she so that the their them then there they this to too up us was we well were what when which who will with would you your".split()
# Words that a tone count takes as positive or negative.
POSITIVE = "amazing beautiful best brilliant bright excited fun glad good great happy helps kind love lovely nice perfect sweet thanks wonderful".split()
NEGATIVE = "angry awful bad boring broken cry hate horrible mess nasty poor sad sick sorry stupid terrible tired ugly upset worst".split()
SLANG = "lol lmao rofl omg btw idk imo imho thx pls plz ttyl brb gonna wanna gotta kinda yeah yep nope nah hmm umm ugh tbh irl afaik".split()
# A small dictionary for spelling; texts of the phrase table are spelled by it.
DICTIONARY = sorted(
    {*STOPWORDS, *POSITIVE, *NEGATIVE, *"adults anna around bike birthday breakfast check come cook day every everyone experts few flights food friday friend full funny garden grew half hello hiking knows label lake lamp last late leave likes map meeting morning most moved near never nine nobody one own parcel people place read received report say see skip station today three trains vaccines wait walk weather weekend went year image omitted media places".split()}
)
