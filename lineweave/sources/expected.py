"""What the readers must find in corpus.TEMPLATES, printed from the readers and checked against the texts: template|relation|function|its first line|line|end|kind|name|path|text|items|number."""

FACTS = """
0|identifiers|~|~|5|5|~|~|~|~|flag§load{i}§path|~
0|identifiers|~|~|6|6|~|~|~|~|args§name§rq|~
0|identifiers|~|~|7|7|~|~|~|~|alias§name|~
0|identifiers|~|~|8|8|~|~|~|~|flag|~
0|identifiers|~|~|9|9|~|~|~|~|alias§flag§step{j}§total|~
0|identifiers|~|~|10|10|~|~|~|~|alias§os§system|~
0|identifiers|~|~|12|12|~|~|~|~|total|~
0|identifiers|~|~|13|13|~|~|~|~|part§path|~
0|identifiers|~|~|14|14|~|~|~|~|part§total|~
0|identifiers|~|~|16|16|~|~|~|~|handle§open§path|~
0|identifiers|~|~|17|17|~|~|~|~|cursor§execute§name|~
0|identifiers|~|~|18|18|~|~|~|~|OSError|~
0|identifiers|~|~|21|21|~|~|~|~|total|~
0|identifiers|~|~|22|22|~|~|~|~|total|~
0|identifiers|~|~|24|24|~|~|~|~|Base§Box{i}|~
0|identifiers|~|~|25|25|~|~|~|~|get§key§self|~
0|identifiers|~|~|26|26|~|~|~|~|key§self|~
0|identifiers|~|~|27|27|~|~|~|~|key§self|~
0|import|~|~|1|1|~|os|os|os|~|~
0|import|~|~|1|1|~|rq|flask|request|~|~
0|import|~|~|1|1|~|step{j}|mod{j}|step{j}|~|~
0|type|~|~|24|27|class|Box{i}|~|~|Base|~
0|function|load{i}|5|5|22||load{i}|~|~|path§flag|~
0|parameter|load{i}|5|5|5|~|path|~||~|0
0|parameter|load{i}|5|5|5|~|flag|~||~|1
0|statement|load{i}|5|6|6|assign|~|~|~|~|~
0|access|load{i}|5|6|6|def|name|name|~|~|~
0|access|load{i}|5|6|6|use|rq|rq.args.[]|~|~|~
0|statement|load{i}|5|7|7|assign|~|~|~|~|~
0|access|load{i}|5|7|7|def|alias|alias|~|~|~
0|access|load{i}|5|7|7|use|name|name|~|~|~
0|alias|load{i}|5|7|7|~|alias|name|~|~|~
0|statement|load{i}|5|8|12|if|~|~|flag > 1|~|~
0|access|load{i}|5|8|8|use|flag|flag|~|~|~
0|test|load{i}|5|8|8|~|flag|~|~|~|~
0|block|load{i}|5|9|10|if|then|8|expr|12§10|0
0|statement|load{i}|5|9|9|assign|~|~|~|~|~
0|access|load{i}|5|9|9|def|total|total|~|~|~
0|access|load{i}|5|9|9|use|alias|alias|~|~|~
0|access|load{i}|5|9|9|use|flag|flag|~|~|~
0|call|load{i}|5|9|9|~|step{j}|~|~|alias§flag|~
0|statement|load{i}|5|10|10|expr|~|~|~|~|~
0|access|load{i}|5|10|10|use|os|os|~|~|~
0|access|load{i}|5|10|10|use|alias|alias|~|~|~
0|call|load{i}|5|10|10|~|system|os|~|"rm " + alias|~
0|block|load{i}|5|12|12|if|else|8|assign|12§12|1
0|statement|load{i}|5|12|12|assign|~|~|~|~|~
0|access|load{i}|5|12|12|def|total|total|~|~|~
0|statement|load{i}|5|13|14|loop|~|~|path|~|~
0|access|load{i}|5|13|13|def|part|part|~|~|~
0|access|load{i}|5|13|13|use|path|path|~|~|~
0|test|load{i}|5|13|13|~|path|~|~|~|~
0|block|load{i}|5|14|14|loop|body|13|assign|14§14|0
0|statement|load{i}|5|14|14|assign|~|~|~|~|~
0|access|load{i}|5|14|14|def|total|total|~|~|~
0|access|load{i}|5|14|14|use|total|total|~|~|~
0|access|load{i}|5|14|14|use|part|part|~|~|~
0|statement|load{i}|5|15|21|try|~|~|~|~|~
0|block|load{i}|5|16|17|try|body|15|expr|21§17|0
0|statement|load{i}|5|16|16|assign|~|~|~|~|~
0|access|load{i}|5|16|16|def|handle|handle|~|~|~
0|access|load{i}|5|16|16|use|path|path|~|~|~
0|call|load{i}|5|16|16|~|open|~|~|path|~
0|statement|load{i}|5|17|17|expr|~|~|~|~|~
0|access|load{i}|5|17|17|use|cursor|cursor|~|~|~
0|access|load{i}|5|17|17|use|name|name|~|~|~
0|call|load{i}|5|17|17|~|execute|cursor|~|"select " + name|~
0|block|load{i}|5|18|19|try|catch|15|return|21§19|1
0|statement|load{i}|5|19|19|return|~|~|None|~|~
0|return|load{i}|5|19|19|conditional|~|~|None|~|~
0|block|load{i}|5|21|21|try|finally|15|assign|21§21|2
0|statement|load{i}|5|21|21|assign|~|~|~|~|~
0|access|load{i}|5|21|21|def|total|total|~|~|~
0|access|load{i}|5|21|21|use|total|total|~|~|~
0|statement|load{i}|5|22|22|return|~|~|total|~|~
0|access|load{i}|5|22|22|use|total|total|~|~|~
0|return|load{i}|5|22|22|plain|~|~|total|~|~
0|function|get|25|25|27||get|Box{i}|~|self§key|~
0|parameter|get|25|25|25|~|self|~||~|0
0|parameter|get|25|25|25|~|key|~||~|1
0|statement|get|25|26|26|assign|~|~|~|~|~
0|access|get|25|26|26|def|self|self.key|~|~|~
0|access|get|25|26|26|use|key|key|~|~|~
0|statement|get|25|27|27|return|~|~|self.key|~|~
0|access|get|25|27|27|use|self|self.key|~|~|~
0|return|get|25|27|27|plain|~|~|self.key|~|~
1|identifiers|~|~|1|1|~|~|~|~|main|~
1|identifiers|~|~|6|6|~|~|~|~|Store{i}|~
1|identifiers|~|~|7|7|~|~|~|~|path|~
1|identifiers|~|~|9|9|~|~|~|~|Request§ResponseWriter§Serve{i}§Store{i}§http§r§s§w|~
1|identifiers|~|~|10|10|~|~|~|~|FormValue§name§r|~
1|identifiers|~|~|11|11|~|~|~|~|name|~
1|identifiers|~|~|14|14|~|~|~|~|Open§err§f§name§os|~
1|identifiers|~|~|15|15|~|~|~|~|Close§f|~
1|identifiers|~|~|16|16|~|~|~|~|n|~
1|identifiers|~|~|17|17|~|~|~|~|name§path§s|~
1|identifiers|~|~|19|19|~|~|~|~|name|~
1|identifiers|~|~|21|21|~|~|~|~|Command§exec§name|~
1|identifiers|~|~|23|23|~|~|~|~|help{i}§name|~
1|identifiers|~|~|25|25|~|~|~|~|err|~
1|identifiers|~|~|27|27|~|~|~|~|help{i}§q|~
1|identifiers|~|~|28|28|~|~|~|~|m§q|~
1|identifiers|~|~|29|29|~|~|~|~|m§step{j}|~
1|import|~|~|1|1|~|os|os|os|~|~
1|import|~|~|1|1|~|exec|os/exec|exec|~|~
1|type|~|~|6|8|struct|Store{i}|~|~||~
1|field|~|~|6|6|~|Store{i}|path|~|~|~
1|function|Serve{i}|9|9|26||Serve{i}|Store{i}|~|w§r|~
1|parameter|Serve{i}|9|9|9|~|w|~|http.ResponseWriter|~|0
1|parameter|Serve{i}|9|9|9|~|r|~|*http.Request|~|1
1|statement|Serve{i}|9|10|10|assign|~|~|~|~|~
1|access|Serve{i}|9|10|10|def|name|name|~|~|~
1|access|Serve{i}|9|10|10|use|r|r|~|~|~
1|call|Serve{i}|9|10|10|~|FormValue|r|~|"name"|~
1|statement|Serve{i}|9|11|13|if|~|~|name == ""|~|~
1|access|Serve{i}|9|11|11|use|name|name|~|~|~
1|test|Serve{i}|9|11|11|~|name|~|~|~|~
1|block|Serve{i}|9|12|12|if|then|11|return|13§12|0
1|statement|Serve{i}|9|12|12|return|~|~|nil|~|~
1|return|Serve{i}|9|12|12|conditional|~|~|nil|~|~
1|statement|Serve{i}|9|14|14|assign|~|~|~|~|~
1|access|Serve{i}|9|14|14|def|f|f|~|~|~
1|access|Serve{i}|9|14|14|def|err|err|~|~|~
1|access|Serve{i}|9|14|14|use|os|os|~|~|~
1|access|Serve{i}|9|14|14|use|name|name|~|~|~
1|call|Serve{i}|9|14|14|~|Open|os|~|name|~
1|statement|Serve{i}|9|15|15|defer|~|~|f.Close()|~|~
1|access|Serve{i}|9|15|15|use|f|f|~|~|~
1|call|Serve{i}|9|15|15|~|Close|f|~||~
1|statement|Serve{i}|9|16|18|loop|~|~|n := 0; n < 3; n++|~|~
1|access|Serve{i}|9|16|16|def|n|n|~|~|~
1|access|Serve{i}|9|16|16|use|n|n|~|~|~
1|access|Serve{i}|9|16|16|use|n|n|~|~|~
1|test|Serve{i}|9|16|16|~|n|~|~|~|~
1|test|Serve{i}|9|16|16|~|n|~|~|~|~
1|test|Serve{i}|9|16|16|~|n|~|~|~|~
1|block|Serve{i}|9|17|17|loop|body|16|assign|18§17|0
1|statement|Serve{i}|9|17|17|assign|~|~|~|~|~
1|access|Serve{i}|9|17|17|def|s|s.path|~|~|~
1|access|Serve{i}|9|17|17|use|name|name|~|~|~
1|alias|Serve{i}|9|17|17|~|s.path|name|~|~|~
1|statement|Serve{i}|9|19|24|switch|~|~|name|~|~
1|access|Serve{i}|9|19|19|use|name|name|~|~|~
1|test|Serve{i}|9|19|19|~|name|~|~|~|~
1|block|Serve{i}|9|21|21|switch|case|19|expr|24§21|0
1|statement|Serve{i}|9|21|21|expr|~|~|~|~|~
1|access|Serve{i}|9|21|21|use|exec|exec|~|~|~
1|access|Serve{i}|9|21|21|use|name|name|~|~|~
1|call|Serve{i}|9|21|21|~|Command|exec|~|"sh"§"-c"§name|~
1|block|Serve{i}|9|23|23|switch|default|19|expr|24§23|1
1|statement|Serve{i}|9|23|23|expr|~|~|~|~|~
1|access|Serve{i}|9|23|23|use|name|name|~|~|~
1|call|Serve{i}|9|23|23|~|help{i}|~|~|name|~
1|statement|Serve{i}|9|25|25|return|~|~|err|~|~
1|access|Serve{i}|9|25|25|use|err|err|~|~|~
1|return|Serve{i}|9|25|25|plain|~|~|err|~|~
1|function|help{i}|27|27|30||help{i}|~|~|q|~
1|parameter|help{i}|27|27|27|~|q|~|string|~|0
1|statement|help{i}|27|28|28|assign|~|~|~|~|~
1|access|help{i}|27|28|28|def|m|m|~|~|~
1|access|help{i}|27|28|28|use|q|q|~|~|~
1|alias|help{i}|27|28|28|~|m|q|~|~|~
1|statement|help{i}|27|29|29|return|~|~|step{j}(m)|~|~
1|access|help{i}|27|29|29|use|m|m|~|~|~
1|call|help{i}|27|29|29|~|step{j}|~|~|m|~
1|return|help{i}|27|29|29|plain|~|~|step{j}(m)|~|~
2|identifiers|~|~|1|1|~|~|~|~|cp§require|~
2|identifiers|~|~|2|2|~|~|~|~|fetchAll§load|~
2|identifiers|~|~|3|3|~|~|~|~|Base{i}§Root|~
2|identifiers|~|~|4|4|~|~|~|~|limit§req§run{i}|~
2|identifiers|~|~|5|5|~|~|~|~|id§kind§req§sort|~
2|identifiers|~|~|6|6|~|~|~|~|id§key|~
2|identifiers|~|~|7|7|~|~|~|~|limit|~
2|identifiers|~|~|8|8|~|~|~|~|fetchAll§key|~
2|identifiers|~|~|10|10|~|~|~|~|item§key|~
2|identifiers|~|~|11|11|~|~|~|~|item§send{i}|~
2|identifiers|~|~|14|14|~|~|~|~|cp§exec§key|~
2|identifiers|~|~|15|15|~|~|~|~|e|~
2|identifiers|~|~|16|16|~|~|~|~|e|~
2|identifiers|~|~|18|18|~|~|~|~|done§key|~
2|identifiers|~|~|20|20|~|~|~|~|sort|~
2|identifiers|~|~|23|23|~|~|~|~|send{i}§x|~
2|identifiers|~|~|24|24|~|~|~|~|Base{i}§box|~
2|identifiers|~|~|25|25|~|~|~|~|box§run{i}§x|~
2|import|~|~|1|1|~|cp|child_process|cp|~|~
2|import|~|~|1|1|~|fetchAll|./m{j}|load|~|~
2|type|~|~|3|22|class|Base{i}|~|~|Root|~
2|made|~|~|1|1|~|Base{i}|~|~|~|~
2|function|run{i}|4|4|21||run{i}|Base{i}|~|req§limit|~
2|parameter|run{i}|4|4|4|~|req|~||~|0
2|parameter|run{i}|4|4|4|~|limit|~||~|1
2|statement|run{i}|4|5|5|assign|~|~|~|~|~
2|access|run{i}|4|5|5|def|id|id|~|~|~
2|access|run{i}|4|5|5|def|sort|sort|~|~|~
2|access|run{i}|4|5|5|use|req|req|~|~|~
2|alias|run{i}|4|5|5|~|id|req.id|~|~|~
2|alias|run{i}|4|5|5|~|sort|req.kind|~|~|~
2|statement|run{i}|4|6|6|assign|~|~|~|~|~
2|access|run{i}|4|6|6|def|key|key|~|~|~
2|access|run{i}|4|6|6|use|id|id|~|~|~
2|alias|run{i}|4|6|6|~|key|id|~|~|~
2|statement|run{i}|4|7|9|if|~|~|limit > 3|~|~
2|access|run{i}|4|7|7|use|limit|limit|~|~|~
2|test|run{i}|4|7|7|~|limit|~|~|~|~
2|block|run{i}|4|8|8|if|then|7|assign|9§8|0
2|statement|run{i}|4|8|8|assign|~|~|~|~|~
2|access|run{i}|4|8|8|def|key|key|~|~|~
2|access|run{i}|4|8|8|use|key|key|~|~|~
2|call|run{i}|4|8|8|~|fetchAll|~|~|key|~
2|statement|run{i}|4|10|12|loop|~|~|const item of key|~|~
2|access|run{i}|4|10|10|def|item|item|~|~|~
2|access|run{i}|4|10|10|use|key|key|~|~|~
2|test|run{i}|4|10|10|~|item|~|~|~|~
2|test|run{i}|4|10|10|~|key|~|~|~|~
2|block|run{i}|4|11|11|loop|body|10|expr|12§11|0
2|statement|run{i}|4|11|11|expr|~|~|~|~|~
2|access|run{i}|4|11|11|use|item|item|~|~|~
2|call|run{i}|4|11|11|~|send{i}|~|~|item|~
2|statement|run{i}|4|13|19|try|~|~|~|~|~
2|block|run{i}|4|14|14|try|body|13|expr|19§14|0
2|statement|run{i}|4|14|14|expr|~|~|~|~|~
2|access|run{i}|4|14|14|use|cp|cp|~|~|~
2|access|run{i}|4|14|14|use|key|key|~|~|~
2|call|run{i}|4|14|14|~|exec|cp|~|"ls " + key|~
2|block|run{i}|4|16|16|try|catch|13|throw|19§16|1
2|statement|run{i}|4|16|16|throw|~|~|e|~|~
2|access|run{i}|4|16|16|use|e|e|~|~|~
2|block|run{i}|4|18|18|try|finally|13|expr|19§18|2
2|statement|run{i}|4|18|18|expr|~|~|~|~|~
2|access|run{i}|4|18|18|use|key|key|~|~|~
2|call|run{i}|4|18|18|~|done|~|~|key|~
2|statement|run{i}|4|20|20|return|~|~|sort|~|~
2|access|run{i}|4|20|20|use|sort|sort|~|~|~
2|return|run{i}|4|20|20|plain|~|~|sort|~|~
2|function|send{i}|23|23|26||send{i}|~|~|x|~
2|parameter|send{i}|23|23|23|~|x|~||~|0
2|statement|send{i}|23|24|24|assign|~|~|~|~|~
2|access|send{i}|23|24|24|def|box|box|~|~|~
2|call|send{i}|23|24|24|~|Base{i}|~|~||~
2|statement|send{i}|23|25|25|return|~|~|box.run{i}(x, 1)|~|~
2|access|send{i}|23|25|25|use|box|box|~|~|~
2|access|send{i}|23|25|25|use|x|x|~|~|~
2|call|send{i}|23|25|25|~|run{i}|box|~|x§1|~
2|return|send{i}|23|25|25|plain|~|~|box.run{i}(x, 1)|~|~
2|statement|~|~|1|1|assign|~|~|~|~|~
2|access|~|~|1|1|def|cp|cp|~|~|~
2|call|~|~|1|1|~|require|~|~|"child_process"|~
3|identifiers|~|~|2|2|~|~|~|~|buf§copy{i}§d§dev§len|~
3|identifiers|~|~|3|3|~|~|~|~|len§n|~
3|identifiers|~|~|4|4|~|~|~|~|malloc§n§p|~
3|identifiers|~|~|5|5|~|~|~|~|p|~
3|identifiers|~|~|7|7|~|~|~|~|handler§step{i}|~
3|identifiers|~|~|8|8|~|~|~|~|d§ops§start{i}§step{i}|~
3|identifiers|~|~|9|9|~|~|~|~|n|~
3|identifiers|~|~|11|11|~|~|~|~|n|~
3|identifiers|~|~|13|13|~|~|~|~|buf§memcpy§n§p|~
3|identifiers|~|~|16|16|~|~|~|~|out|~
3|identifiers|~|~|18|18|~|~|~|~|n|~
3|identifiers|~|~|19|19|~|~|~|~|n|~
3|identifiers|~|~|21|21|~|~|~|~|handler§n|~
3|identifiers|~|~|22|22|~|~|~|~|d§p§start{i}|~
3|identifiers|~|~|23|23|~|~|~|~|out|~
3|identifiers|~|~|24|24|~|~|~|~|free§p|~
3|identifiers|~|~|25|25|~|~|~|~|n|~
3|identifiers|~|~|27|27|~|~|~|~|step{i}§v|~
3|identifiers|~|~|28|28|~|~|~|~|v§w|~
3|identifiers|~|~|29|29|~|~|~|~|copy{j}§w|~
3|function|copy{i}|2|2|26|static|copy{i}|~|~|d§buf§len|~
3|parameter|copy{i}|2|2|2|~|d|~|struct dev *|~|0
3|parameter|copy{i}|2|2|2|~|buf|~|char *|~|1
3|parameter|copy{i}|2|2|2|~|len|~|int|~|2
3|statement|copy{i}|2|3|3|assign|~|~|~|~|~
3|access|copy{i}|2|3|3|def|n|n|~|~|~
3|access|copy{i}|2|3|3|use|len|len|~|~|~
3|alias|copy{i}|2|3|3|~|n|len|~|~|~
3|statement|copy{i}|2|4|4|assign|~|~|~|~|~
3|access|copy{i}|2|4|4|def|p|p|~|~|~
3|access|copy{i}|2|4|4|use|n|n|~|~|~
3|call|copy{i}|2|4|4|~|malloc|~|~|n|~
3|statement|copy{i}|2|5|6|if|~|~|!p|~|~
3|access|copy{i}|2|5|5|use|p|p|~|~|~
3|test|copy{i}|2|5|5|~|p|~|~|~|~
3|block|copy{i}|2|6|6|if|then|5|return|6§6|0
3|statement|copy{i}|2|6|6|return|~|~|-1|~|~
3|return|copy{i}|2|6|6|conditional|~|~|-1|~|~
3|statement|copy{i}|2|7|7|assign|~|~|~|~|~
3|access|copy{i}|2|7|7|def|handler|handler|~|~|~
3|access|copy{i}|2|7|7|use|step{i}|step{i}|~|~|~
3|alias|copy{i}|2|7|7|~|handler|step{i}|~|~|~
3|statement|copy{i}|2|8|8|assign|~|~|~|~|~
3|access|copy{i}|2|8|8|def|d|d.ops.start{i}|~|~|~
3|access|copy{i}|2|8|8|use|step{i}|step{i}|~|~|~
3|alias|copy{i}|2|8|8|~|d.ops.start{i}|step{i}|~|~|~
3|statement|copy{i}|2|9|17|switch|~|~|n|~|~
3|access|copy{i}|2|9|9|use|n|n|~|~|~
3|test|copy{i}|2|9|9|~|n|~|~|~|~
3|block|copy{i}|2|11|11|switch|case|9|assign|17§11|0
3|statement|copy{i}|2|11|11|assign|~|~|~|~|~
3|access|copy{i}|2|11|11|def|n|n|~|~|~
3|block|copy{i}|2|13|14|switch|case|9|break|17§14|1
3|statement|copy{i}|2|13|13|expr|~|~|~|~|~
3|access|copy{i}|2|13|13|use|p|p|~|~|~
3|access|copy{i}|2|13|13|use|buf|buf|~|~|~
3|access|copy{i}|2|13|13|use|n|n|~|~|~
3|call|copy{i}|2|13|13|~|memcpy|~|~|p§buf§n|~
3|statement|copy{i}|2|14|14|break|~|~|~|~|~
3|block|copy{i}|2|16|16|switch|default|9|goto|17§16|2
3|statement|copy{i}|2|16|16|goto|~|~|out|~|~
3|statement|copy{i}|2|18|20|loop|~|~|n > 0|~|~
3|access|copy{i}|2|18|18|use|n|n|~|~|~
3|test|copy{i}|2|18|18|~|n|~|~|~|~
3|block|copy{i}|2|19|19|loop|body|18|assign|20§19|0
3|statement|copy{i}|2|19|19|assign|~|~|~|~|~
3|access|copy{i}|2|19|19|def|n|n|~|~|~
3|access|copy{i}|2|19|19|use|n|n|~|~|~
3|statement|copy{i}|2|21|21|expr|~|~|~|~|~
3|access|copy{i}|2|21|21|use|n|n|~|~|~
3|call|copy{i}|2|21|21|~|handler|~|~|n|~
3|statement|copy{i}|2|22|22|expr|~|~|~|~|~
3|access|copy{i}|2|22|22|use|d|d|~|~|~
3|access|copy{i}|2|22|22|use|p|p|~|~|~
3|call|copy{i}|2|22|22|~|start{i}|d|~|p|~
3|statement|copy{i}|2|23|23|label|~|~|out|~|~
3|statement|copy{i}|2|24|24|expr|~|~|~|~|~
3|access|copy{i}|2|24|24|use|p|p|~|~|~
3|call|copy{i}|2|24|24|~|free|~|~|p|~
3|statement|copy{i}|2|25|25|return|~|~|n|~|~
3|access|copy{i}|2|25|25|use|n|n|~|~|~
3|return|copy{i}|2|25|25|plain|~|~|n|~|~
3|function|step{i}|27|27|30||step{i}|~|~|v|~
3|parameter|step{i}|27|27|27|~|v|~|int|~|0
3|statement|step{i}|27|28|28|assign|~|~|~|~|~
3|access|step{i}|27|28|28|def|w|w|~|~|~
3|access|step{i}|27|28|28|use|v|v|~|~|~
3|statement|step{i}|27|29|29|return|~|~|copy{j}(0, 0, w)|~|~
3|access|step{i}|27|29|29|use|w|w|~|~|~
3|call|step{i}|27|29|29|~|copy{j}|~|~|0§0§w|~
3|return|step{i}|27|29|29|plain|~|~|copy{j}(0, 0, w)|~|~
"""
